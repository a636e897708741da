"""Operators over the whole table: fingerprints, substring dedup, MinHash, passages,
mixing, and the pipeline."""

import hashlib
import os
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from furrow.llm import fingerprint, minhash, passages, substring
from furrow.llm.common import discard, mix, stage
from furrow.llm.components import components
from furrow.llm.fingerprint import PIECE_CHARS, fingerprints
from furrow.llm.minhash import near_duplicates
from furrow.llm.mixing import mix_sources
from furrow.llm.passages import compact_windows, repeated_passages
from furrow.llm.substring import remove_repeats
from furrow.llm.suffixes import anchored_runs, multikey_order

LEAST = -(1 << 63)


def _low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", _low(text)) if w]


def _texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# ---- fingerprints

def _plain_near(a, b):
    x, y = (set(re.findall(r"[^\n]{1,%d}" % PIECE_CHARS, t)) for t in (a, b))
    return 1.0 if not x | y else len(x & y) / len(x | y)


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_fingerprints_recover_the_differences(spark, odd, sf, table):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"]) if table == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    rows = sorted(_texts(docs))
    prints = {}
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(_plain_near(text, edited))
        assert r.near_next == pytest.approx(_plain_near(text, after))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(got) == len(rows)


def test_fingerprints_do_not_depend_on_the_ranges(spark, sf, odd, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for table in (docs, odd):
        few = sorted(map(str, fingerprints(table).collect()))
        monkeypatch.setattr(fingerprint, "RANGE_BYTES", 4_000)
        made = []
        real = fingerprint._with_next
        monkeypatch.setattr(fingerprint, "_with_next", lambda texts, n: made.append(n) or real(texts, n))  # noqa: B023
        assert sorted(map(str, fingerprints(table).collect())) == few
        assert made[0] > 8 or table is odd
        monkeypatch.undo()


def test_fingerprints_of_repeated_null_and_no_rows(odd, nothing):
    rows = fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert sorted(r.near_next for r in rows if r.doc_id == 5)[-1] == 1.0     # repeated rows stand next to each other
    assert fingerprints(nothing).count() == 0
    one = fingerprints(odd.where("doc_id = 18")).first()
    assert one.near_next == 1.0


# ---- substring dedup

def _plain_removed(rows, length=100):
    seen, out = {}, {}
    for key, text in sorted(((LEAST if k is None else k, t) for k, t in rows), key=lambda r: r[0]):
        data = (text or "").encode()
        covered = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            w = data[p:p + length]
            if seen.setdefault(w, (key, p)) != (key, p):
                covered[p:p + length] = True
        runs = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()) if len(data) else 0
        out[key] = (len(data), int(covered.sum()), runs, hashlib.sha256(np.frombuffer(data, np.uint8)[~covered].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("buckets", ["3", "40"])
def test_removed_bytes_against_plain_search(spark, odd, nothing, buckets):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", buckets)
    try:
        rows = remove_repeats(odd).collect()
        want = _plain_removed(_texts(odd))
        assert len(rows) == odd.count()
        for r in rows:
            assert tuple(r[1:]) == want[LEAST if r.doc_id is None else r.doc_id], r.doc_id
        assert remove_repeats(nothing).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_removed_bytes_equal_those_of_the_sql(spark, sf):
    import duckdb
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(tuple(r) for r in remove_repeats(docs).collect()) == sorted(con.execute(substring.ORACLE).fetchall())
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (3, repeat('ab', 80)), (1, NULL), (2, ''), "
                "(7, repeat('é', 70)), (9, repeat('x', 99)), (11, repeat('é', 60) || repeat('ab', 51))) t(doc_id, text)")
    few = spark.createDataFrame(con.execute("SELECT * FROM documents").fetchall(), "doc_id long, text string")
    assert sorted(tuple(r) for r in remove_repeats(few).collect()) == sorted(con.execute(substring.ORACLE).fetchall())


def test_frequent_passage_spreads_over_buckets(spark):
    """One passage in most documents, with other neighbours: its anchors span buckets."""
    passage = "the same passage in very many documents with enough bytes to hold several anchors of thirty two bytes each, " * 3
    docs = spark.createDataFrame([(i, f"{i * 7919} before {passage} after {i * 104729}") for i in range(300)], "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = {r.doc_id: tuple(r[1:]) for r in remove_repeats(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == _plain_removed(_texts(docs))


def test_frequent_line_between_unique_texts(spark, monkeypatch):
    """Many buckets, one line of 130 bytes: its anchor's runs reach into unique neighbours, whose
    blocks of windows are dropped by their cores; repeats inside a task and between tasks."""
    rnd = np.random.default_rng(6)
    line = "a license line that stands in every document of the table, word for word, with more than one hundred bytes " + "and an end of it"
    word = lambda: "".join(chr(97 + int(c)) for c in rnd.integers(0, 26, 9))
    rows = [(i, " ".join(word() for _ in range(12)) + line + (" shared tail of a few documents" if i % 5 == 0 else "") + " ".join(word() for _ in range(12)))
            for i in range(400)]
    rows += [(500 + i, line[:105] if i % 2 else line) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(substring, "SAMPLE_ROWS", 400)
    made = []
    real = substring._wide_repeats
    monkeypatch.setattr(substring, "_wide_repeats", lambda runs, length: made.append(runs.count()) or real(runs, length))
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        got = {r.doc_id: tuple(r[1:]) for r in remove_repeats(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == _plain_removed(_texts(docs)) and made[0] > 100


def test_runs_cover_all_windows_and_order_is_lexicographic():
    rnd = np.random.default_rng(1)
    raw = rnd.integers(97, 99, 3000).astype(np.uint8)
    starts = np.array([0, 0, 50, 900, 1000, 3000])
    first, last, place, gram, content, check = anchored_runs(raw, starts, 100)
    assert len(set(zip(content.tolist(), check.tolist()))) == len({bytes(raw[a:b + 100]) for a, b in zip(first, last, strict=True)})
    windows = [p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)]
    assert windows == [p for a, b in zip(starts[:-1], starts[1:], strict=True) for p in range(a, b - 99)]
    assert (place >= last).all() and (place + 32 <= first + 100).all()
    keys = [rnd.integers(0, 4, 2000) for _ in range(4)]
    assert (multikey_order(keys) == np.lexsort(keys[::-1])).all()


# ---- MinHash

def _plain_components(rows):
    sets, ids = {}, [k for k, _ in rows if k is not None]
    for k, t in rows:
        w = _words(t)
        n = min(5, len(w))
        sets.setdefault(k, {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = {k: k for k in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_near_duplicates_against_all_pairs(spark, odd, sf, table):
    docs = odd if table == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    want = _plain_components(_texts(docs))
    rows = near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
        else:
            assert not r.kept


def test_groups_of_unlinked_candidates_and_no_rows(spark, nothing):
    """Many texts that share half of their words: candidates, but few links."""
    rnd = np.random.default_rng(2)
    core = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = [f"w{i}_{j}" for j in range(int(rnd.integers(5, 25)))]
        rows.append((i, " ".join(core + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _plain_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()} == want
    assert near_duplicates(nothing).count() == 0


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(3)
    a = rnd.integers(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate((a[:320], rnd.integers(0, 1 << 62, 80).astype(np.uint64)))
    assert (minhash.signature(a) == minhash.signature(b)).mean() == pytest.approx(320 / 480, abs=0.15)
    assert (minhash.signature(a[::-1].copy()) == minhash.signature(a)).all()


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)] + [(200, 100)], "a long, b long")
    got = {r.node: r.component for r in components(chain, "a", "b").collect()}
    assert got == {i: 0 for i in range(65)} | {200: 100, 100: 100}


# ---- passages

def test_compact_windows_are_the_tree_nodes():
    rnd = np.random.default_rng(4)
    for _ in range(150):
        n, t = int(rnd.integers(1, 60)), int(rnd.integers(1, 8))
        h = mix(rnd.integers(0, 25, n).astype(np.uint64))
        want = set()

        def nodes(a, b):
            if b - a + 1 >= t:
                m = a + int(np.argmin(h[a:b + 1]))                 # noqa: B023
                want.add((a, m, b))                                # noqa: B023
                nodes(a, m - 1)
                nodes(m + 1, b)

        nodes(0, n - 1)
        assert set(zip(*(x.tolist() for x in compact_windows(h, t)), strict=True)) == want
        if n > 9:                                       # parted into two documents
            want.clear()
            nodes(0, 3)
            nodes(6, n - 1)
            assert set(zip(*(x.tolist() for x in compact_windows(h, t, np.array([4, 5]))), strict=True)) == want


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_every_repeat_of_fifty_words_is_covered(spark, odd, sf, table):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"]) if table == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in repeated_passages(docs).collect()}
    words = {k: _words(t) for k, t in _texts(docs)}
    assert got.keys() == words.keys()
    where = {}
    for k, w in words.items():
        for i in range(len(w) - 49):
            where.setdefault(tuple(w[i:i + 50]), set()).add(k)
    for k, w in words.items():
        covered = np.zeros(len(w), bool)
        for p in got[k].passages:
            covered[p["start"]:p["stop"]] = True
        assert got[k].n_repeated == covered.sum()
        for i in range(len(w) - 49):
            others = where[tuple(w[i:i + 50])]
            if len(others) > 1:
                # A text that repeats one word is covered only where it meets the other.
                assert covered[i:i + 50].all() or len(set(w)) == 1 and covered.any(), (k, i)
                assert len({got[o].class_id for o in others}) == 1
        if not got[k].n_links:
            assert got[k].class_id == k and not got[k].passages


def test_passages_of_repeated_null_and_no_rows(odd, nothing):
    rows = repeated_passages(odd).collect()
    assert len(rows) == odd.count()
    assert len({tuple(r[1:4]) for r in rows if r.doc_id == 5}) == 1
    assert repeated_passages(nothing).count() == 0


def test_lightly_edited_passage_is_found(spark):
    rnd = np.random.default_rng(5)
    text = lambda n: [f"w{x}" for x in rnd.integers(0, 5000, n)]
    passage = text(120)
    edited = list(passage)
    edited[40] = "changed"
    docs = spark.createDataFrame([(1, " ".join(text(80) + passage + text(90))), (2, " ".join(text(60) + edited + text(50))),
                                  (3, " ".join(text(300)))], "doc_id long, text string")
    got = {r.doc_id: r for r in repeated_passages(docs).collect()}
    assert got[1].class_id == got[2].class_id == 1 and got[1].n_links == 1 and got[3].n_links == 0
    assert abs(got[1].n_repeated - 120) <= 5
    assert passages.NEED <= passages.FUNCTIONS


def _with_partitions(spark, n, docs):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        return {r.doc_id: r for r in repeated_passages(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_passage_in_most_documents_at_any_number_of_buckets(spark):
    rnd = np.random.default_rng(8)
    text = lambda n: [f"w{x}" for x in rnd.integers(0, 50_000, n)]
    passage = text(60)
    docs = spark.createDataFrame([(i, " ".join(text(12) + passage + text(9) if i % 10 else text(80))) for i in range(400)],
                                 "doc_id long, text string")
    few, many = _with_partitions(spark, 3, docs), _with_partitions(spark, 40, docs)
    for i, r in many.items():
        assert (r.class_id, r.n_repeated >= 60) == ((1, True) if i % 10 else (i, False)), i
    assert few == many


def test_further_copies_and_passages_hidden_behind_a_common_phrase(spark):
    rnd = np.random.default_rng(9)
    text = lambda n: [f"w{x}" for x in rnd.integers(0, 50_000, n)]
    passage, hidden = text(55), text(54)
    texts = [text(30) + passage + text(200) + passage + text(20), text(9) + passage + text(8)]   # twice in the first
    # Documents 2 to 4 hold each a part of under 50 words of what 5 and 6 share.
    texts += [text(40) + hidden[a:b] + text(40) for a, b in ((0, 30), (14, 44), (24, 54))]
    texts += [text(60) + hidden + text(50), text(35) + hidden + text(70)]
    texts += [["word"] * 400, ["word"] * 150]
    got = _with_partitions(spark, 5, spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert [got[i].class_id for i in range(9)] == [0, 0, 2, 3, 4, 5, 5, 7, 7]
    assert [sum(a - 6 < p["start"] <= a for p in got[0].passages) for a in (30, 285)] == [1, 1]
    assert [got[i].n_repeated >= n for i, n in ((0, 110), (1, 55), (5, 54), (6, 54))] == [True] * 4
    assert (got[7].n_repeated, got[8].n_repeated) == (400, 150)


def test_near_copies_whose_minima_meet_several_documents(spark):
    """Each document of a chain of edits meets others under single functions."""
    f = np.arange(passages.FUNCTIONS, dtype=np.int8)
    n = len(f)
    at = np.arange(10, 10 + n, dtype=np.int32)
    columns = [np.full(n, 9), at - 5, at, at + 50, np.arange(n), at - 5, at, at + 50, f]
    batch = lambda k: passages.pa.RecordBatch.from_arrays([passages.pa.array(c[:k]) for c in columns], names=passages._MEETING_NAMES[:9])
    assert sum(b.num_rows for b in passages._candidates([batch(n)])) == n
    assert sum(b.num_rows for b in passages._candidates([batch(1)])) == 0


def test_no_link_of_a_chain_is_lost(spark):
    """The ends of each chain resemble its middle only, and the first has the smallest id, so
    the others' windows meet its windows first."""
    rnd = np.random.default_rng(14)
    text = lambda n: [f"w{x}" for x in rnd.integers(0, 500_000, n)]
    rows = []
    for chain in range(40):
        passage = text(60)
        for k, edit in enumerate((20, None, 40)):
            words = [f"new{chain}x{k}" if i == edit else w for i, w in enumerate(passage)]
            rows.append((100 * k + chain, " ".join(text(int(rnd.integers(5, 40))) + words + text(20))))
    got = {r.doc_id: r.class_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 100 for i, _ in rows}


def test_links_beside_a_common_phrase(spark):
    """A phrase below the bound is in all documents, and in pairs or thirty of them a shared
    stretch beside it that is too short for a minimum of its own."""
    rnd = np.random.default_rng(15)
    text = lambda n: [f"w{x}" for x in rnd.integers(0, 500_000, n)]
    phrase, beside = text(37), [text(14) for _ in range(12)]
    rows = [(i, " ".join(text(50) + phrase + text(1) + (beside[i % 10] if 40 <= i < 60 else beside[11] if i >= 60 else text(14)) + text(50)))
            for i in range(90)]
    got = {r.doc_id: r.class_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 40 + i % 10 if 40 <= i < 60 else min(i, 60) for i in range(90)}


def test_passages_at_the_bound_are_verified():
    rnd = np.random.default_rng(16)

    def similar(s, o):
        return len(set(s) & set(o)) >= 0.75 * len(set(s) | set(o))

    for trial in range(300):
        # Runs of shared tokens, breaks of 4 to 12 others on each side, other tokens around.
        sizes = rnd.integers(12, 40, rnd.integers(1, 6))
        s, o, a = [], [], 0
        for k, size in enumerate(sizes.tolist()):
            if k:
                s += rnd.integers(10**6, 10**9, rnd.integers(4, 13)).tolist()
                o += rnd.integers(10**6, 10**9, rnd.integers(4, 13)).tolist()
            s, o, a = s + list(range(a, a + size)), o + list(range(a, a + size)), a + size
        at_bound = len(s) >= passages.T and len(o) >= passages.T and similar(s, o)
        around = [rnd.integers(10**9, 10**12, n).tolist() for n in rnd.integers(0, 90, 4)]
        s, o = (np.array(x, np.uint64) for x in (around[0] + s + around[1], around[2] + o + around[3]))
        found = list(passages.verified_runs(s, o))
        assert found or not at_bound, trial
        for a, b, oa, ob in found:
            assert min(b - a, ob - oa) >= passages.T - 1 and similar(s[a:b + 1].tolist(), o[oa:ob + 1].tolist())


def test_pairs_of_classes_that_cannot_link_are_not_listed():
    """Near copies edited everywhere share enough tokens for the bound, but nowhere close
    enough together; the ones that do are all listed."""
    rnd = np.random.default_rng(17)
    n, base = 60, [f"w{x}" for x in rnd.integers(0, 50_000, 240)]
    texts = []
    for i in range(n):
        keep = rnd.random(len(base)) > (1 / 12 if i % 10 else 1 / 150)
        texts.append(" ".join(w if k else f"new{i}x{j}" for j, (w, k) in enumerate(zip(base, keep, strict=True))))
    wanted = [[{"key": 1, "c": 118, "class": i, "covered": True}] for i in range(n)]
    kind = pa.list_(pa.struct([("key", pa.int64()), ("c", pa.int32()), ("class", pa.int64()), ("covered", pa.bool_())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts), pa.array(wanted, kind)], names=["id", "text", "wanted"])
    listed = {(x, y) for b in passages._counted(passages._contexts([batch]))
              for x, y in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), strict=True)}
    tokens = list(passages._token_lists(pa.array([x.encode() for x in texts])))
    linked = {(i, j) for i in range(n) for j in range(i) if list(passages.verified_runs(tokens[i], tokens[j]))}
    assert len(linked) >= 15 and linked <= listed and len(listed) <= len(linked) + n


def test_contexts_of_verified_pairs_can_hold_passages():
    rnd = np.random.default_rng(18)
    found = 0
    for _ in range(400):
        base = rnd.choice(10**6, int(rnd.integers(50, 230)), replace=False)
        s, o = ([int(x) if k else int(y) for x, y, k in zip(base, rnd.integers(10**6, 10**9, len(base)), rnd.random(len(base)) > p, strict=True)]
                for p in rnd.random(2) * 0.3)
        s, o = s[int(rnd.integers(0, 20)):], o[int(rnd.integers(0, 20)):]
        if list(passages.verified_runs(*(np.array(x, np.uint64) for x in (s, o)))):
            found += 1
            number = np.unique(s + o, return_inverse=True)[1]
            ordered = np.array([len(set(x)) == len(x) for x in (s, o)])
            assert passages._can_hold_passage(np.array([1]), np.array([0]), number, np.array([len(s), len(o)]), ordered, np.arange(2)).all()
    assert 50 < found < 350


def test_contexts_beyond_the_text_of_a_repeated_id():
    """Windows of one row of an id, and the shorter text of another one."""
    kind = pa.list_(pa.struct([("key", pa.int64()), ("c", pa.int32()), ("class", pa.int64()), ("covered", pa.bool_())]))
    wanted = pa.array([[{"key": 1, "c": c, "class": 3, "covered": False} for c in (500, 5)]], kind)
    batch = pa.RecordBatch.from_arrays([pa.array([3], pa.int64()), pa.array([" ".join(f"w{x}" for x in range(60))]), wanted], names=["id", "text", "wanted"])
    (got,) = passages._contexts([batch])
    assert got.column(4).to_pylist() == [[5], [500]] and list(map(len, got.column(7).to_pylist())) == [56 * passages._TOKEN_BYTES, 0]


def _context_batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.bool_(), pa.binary())
    names = ["key", "doc", "c", "class", "bare", "least", "ordered", "tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def test_memory_of_a_counted_group_is_bounded():
    """All pairs of a group share enough; they are not held at once."""
    batch = _context_batch([(1, i, 9, 7, [9], 1, False, b"abcdefghi" + i.to_bytes(3, "little")) for i in range(4000)])
    tracemalloc.start()
    met = [b for b in passages._counted([batch]) if b.num_rows]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(int((np.asarray(b.column(8)) == passages._COUNTED).sum()) for b in met) == 4000 * passages.MOST
    assert peak < 250 << 20


def test_large_groups_of_windows_are_not_held(monkeypatch):
    rnd = np.random.default_rng(19)
    key, doc = np.sort(rnd.integers(0, 6, 4000) ** 3), rnd.integers(0, 300, 4000)
    doc[np.flatnonzero(key == 1)[:40]] = 5
    rows = sorted(set(zip(key.tolist(), doc.tolist(), rnd.integers(0, 900, 4000).tolist(), strict=True)))
    columns = [np.array(c) for c in zip(*rows, strict=True)]
    pieces = lambda n: [pa.RecordBatch.from_arrays([pa.array(c[a:a + n]) for c in columns], names=passages._WINDOW_NAMES) for a in range(0, len(rows), n)]
    met = lambda n: sorted(r for b in passages._meetings(iter(pieces(n))) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    whole = met(len(rows))
    largest = []
    monkeypatch.setattr(passages, "ROWS", 20)
    inner = passages._group_meetings
    monkeypatch.setattr(passages, "_group_meetings", lambda *x: (largest.append(len(x[0])), inner(*x))[1])
    assert met(7) == whole and len(whole) > 3000 and max(largest) < 100


def test_groups_dealt_as_blocks_give_the_same(spark, monkeypatch):
    rnd = np.random.default_rng(20)
    text = lambda n: [f"w{x}" for x in rnd.integers(0, 500_000, n)]
    phrase, beside = text(37), [text(14) for _ in range(12)]
    docs = spark.createDataFrame([(i, " ".join(text(50) + phrase + text(1) + (beside[i % 10] if 40 <= i < 60 else text(14)) + text(50)))
                                  for i in range(90)], "doc_id long, text string")
    want = {r.doc_id: r.class_id for r in repeated_passages(docs).collect()}
    monkeypatch.setattr(passages, "GROUP_BYTES", 16_000)
    assert {r.doc_id: r.class_id for r in repeated_passages(docs).collect()} == want == {i: 40 + i % 10 if 40 <= i < 60 else i for i in range(90)}


def test_uncovered_windows_meet_all_that_may_cover_them(spark):
    """Round by round, until none is left; windows that a passage covers by then are out."""
    n = 40
    batch = _context_batch([(1, i, 9, 7, [9], 1, False, b"abcdefghi" + i.to_bytes(3, "little")) for i in range(n)])
    met, lo, hi, more = set(), 0, passages.MOST, True
    while more:
        rows = [r for b in passages._counted([batch], lo, hi) for r in zip(*(b.column(k).to_pylist() for k in (0, 4, 8)), strict=True)]
        met |= {r[:2] for r in rows if r[2] == passages._COUNTED}
        more = any(r[2] == passages._MORE for r in rows)
        lo, hi = hi, 2 * hi
    assert met == {(i, j) for i in range(n) for j in range(n) if i != j}
    contexts = spark.createDataFrame([(1, 5, 9, 7, [9, 300], 1, False, b"abc"), (1, 6, 9, 7, [9], 1, False, b"abc"), (2, 5, 9, 7, [9], 1, False, b"abc")],
                                     passages._CONTEXT)
    more = spark.createDataFrame([(5, 9, 1), (5, 300, 1), (6, 9, 1), (5, 9, 2)], "doc bigint, c int, key bigint")
    spans = spark.createDataFrame([(5, 1, 0, 60), (6, 1, 250, 320)], "doc bigint, other bigint, start bigint, stop bigint")
    assert {(r.key, r.doc, tuple(r.bare)) for r in passages._still_bare(contexts, more, spans).collect()} == {(1, 5, (300,)), (1, 6, (9,))}


def test_staged_tables_of_a_round_are_deleted(spark):
    table = stage(spark.range(10).toDF("x"))
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    assert os.path.isdir(folder)
    discard(table)
    assert not os.path.exists(folder)


# ---- mixing

def _plain_targets(sizes):
    """Share by weight; what lies above a cap goes to the others, again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, target, fixed = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(3.0 * sizes[s] for s in fixed)
        free = [s for s in names if s not in fixed]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3.0 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in fixed else share[s] for s in names}
        fixed |= over


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_mix_reaches_its_targets(spark, odd, sf, table):
    docs = odd if table == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    rows = mix_sources(docs).collect()
    assert len(rows) == docs.count()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((k, len(_words(t))) for k, t in _texts(docs))
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    target = _plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 3
    again = {(r.doc_id, r.size, r.taken) for r in mix_sources(docs, keep_text=False).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in rows}


def test_inclusion_follows_the_probabilities(spark):
    """Many sources with the same sizes: documents of a size are included as often as p says."""
    sizes = [1, 2, 3, 5, 8, 13, 40]
    rows = [(s * 100 + i, " ".join(["w"] * n), f"s{s:04d}") for s in range(600) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(docs, weights=(1, 3), keep_text=False).collect()
    whole = {r.doc_id // 100: int(r.target // r.source_size) for r in got}
    assert {r.target / r.source_size for r in got} == {0.5, 1.5}
    # Half of 72 words: 40 is more than half, so it is certain at c = 36 / sum of squares; worked out by hand.
    left, sure, rest = sizes[:], [], 36.0
    while left and rest * max(left) >= sum(x * x for x in left):
        sure.append(max(left))
        rest -= max(left)
        left.remove(max(left))
    c = rest / sum(x * x for x in left) if rest > 0 else 0.0
    if rest <= 0:       # the certain one alone passes the target: it is taken in part, the others never
        want = {n: (36 / 40 if n == 40 else 0.0) for n in sizes}
    else:
        want = {n: 1.0 if n in sure else c * n for n in sizes}
    for n in sizes:
        share = [(r.taken - whole[r.doc_id // 100] * r.size) / r.size for r in got if r.size == n]
        assert abs(np.mean(share) - want[n]) < 0.08, (n, np.mean(share), want[n])
    even = [(s * 100 + i, " ".join(["w"] * n), f"s{s:04d}") for s in range(600) for i, n in enumerate([2, 2, 4, 4, 6, 6])]
    got = mix_sources(spark.createDataFrame(even, docs.schema), weights=(1, 3), keep_text=False).collect()
    for n in (2, 4, 6):     # c = 12 / 112
        share = [(r.taken - int(r.target // r.source_size) * r.size) / r.size for r in got if r.size == n]
        assert abs(np.mean(share) - 12 / 112 * n) < 0.06, (n, np.mean(share))


def test_mix_keeps_columns_of_any_name(spark):
    names = ["_id", "_rank", "_open", "_size", "_one", "__in0", "a.b"]
    docs = spark.createDataFrame([(i, "one two three", "s", *(f"{n}{i}" for n in names)) for i in range(20)],
                                 ["doc_id", "text", "source", *names])
    for r in mix_sources(docs).collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in names)


def test_mix_of_no_rows_and_of_empty_texts(spark, nothing):
    assert mix_sources(nothing).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mix_sources(empty).collect()] == [(0, 0.0, 0)] * 2


# ---- pipeline

def test_pipeline_stages_and_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert set(docs.columns) <= set(out.columns)
    now = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, now, sf)
        assert after.columns == docs.columns, name
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= {r.doc_id for r in now.select("doc_id").collect()}
        if name == "near_dedup":
            want = _plain_components(_texts(now))
            assert kept == {k for k, (_, c) in want.items() if c == k}
        now = spark.createDataFrame(after.collect(), after.schema)
    want = {(r.doc_id, r.text, r.taken) for r in mix_sources(now).where("taken > 0").collect()}
    assert {(r.doc_id, r.text, r.taken) for r in rows} == want


def test_pipeline_on_no_rows(spark, nothing, tmp_path):
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
