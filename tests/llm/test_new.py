"""Collocations, conversation repair and token files against plain versions."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from furrow.llm import collocations as C
from furrow.llm import token_files as T
from furrow.llm.collocations import collocations
from furrow.llm.conversations import cheapest_edits, damage, repair_conversations, repaired_rows
from furrow.llm.token_files import TokenFile, digest_token_files, read_token_files, write_token_files

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- collocations

def _plain_collocations(rows, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= 10}
        for p, a in candidates.items():
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if not any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                       for q, b in candidates.items()):
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def _phrase_rows():
    rnd = random.Random(3)
    words = ["New", "york", "city", "é", "é", "the", "of", "a-b", "x" * 70, "中", "don't"]
    rows = []
    for i in range(160):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".", "! "]) for _ in range(rnd.randint(0, 60)))
        rows.append((i, text, rnd.choice(["en", "en", None, "und", "fr"])))
    rows += [(None, None, None), (200, "", "en"), (201, "...", "de"), rows[5], rows[5], (202, "a b c " * 9, "once")]
    return rows


@pytest.mark.parametrize("whole_hash", [True, False])
def test_collocations_equal_plain_counts(spark, monkeypatch, whole_hash):
    rows = _phrase_rows()
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, lang string, n string, rank int").repartition(3)
    if not whole_hash:      # colliding fingerprints: phrases come apart by their bytes
        few = C.mix
        monkeypatch.setattr(C, "mix", lambda x: few(x % np.uint64(97)) if len(x) > 1 else few(x))
    # Run the passes here, so that the patched hash counts.
    local = [(lang, text) for _, text, lang in rows]
    want = _plain_collocations(local)
    if whole_hash:
        got = collocations(docs)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == want
        assert len(collocations(docs, top=3).collect()) == sum(1 for w in want if w[1] <= 3)
    else:
        counts = Counter()
        import pyarrow as pa
        texts = pa.record_batch([pa.array([lang or "und" for lang, _ in local]), pa.array([t or "" for _, t in local])], names=["lang", "text"])
        blocks = list(C._prepare([texts]))
        for out in C._count(0)(b.select(["block", "lang", "data"]) for b in blocks):
            table = C._frequent(pa.table({c: out.column(c) for c in ("range", "block", "prints", "counts")}))
            for b in blocks:
                n = len(b)
                sent = pa.record_batch({"block": b.column(0).slice(0, 1), "range": table["range"].combine_chunks(),
                                        "lang": pa.nulls(1, pa.string()), "data": pa.nulls(1, pa.string()),
                                        "prints": table["prints"].combine_chunks(), "cut": pa.array([32], pa.int32())})
                data = pa.record_batch({"block": b.column(0), "range": pa.nulls(n, pa.int64()), "lang": b.column(1), "data": b.column(2),
                                        "prints": pa.nulls(n, pa.binary()), "cut": pa.nulls(n, pa.int32())})
                for found in C._materialise([sent, data]):
                    for lang, phrase, k in zip(*(c.to_pylist() for c in found.columns), strict=True):
                        counts[lang, phrase] += k
        for lang, _, phrase, a, *_ in want:
            assert counts[lang, phrase] == a


def test_collocations_in_small_blocks_and_ranges(spark, monkeypatch, odd, nothing, sf):
    assert collocations(nothing).collect() == []
    want = _plain_collocations([(r.lang, r.text) for r in odd.collect()])
    assert sorted(map(tuple, collocations(odd).collect())) == want
    monkeypatch.setattr(C, "RANGE_BYTES", 1 << 14)      # many ranges
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = _plain_collocations([(r.lang, r.text) for r in docs.collect()])
    assert sorted(map(tuple, collocations(docs.repartition(5)).collect())) == want


def test_packed_numbers_and_long_texts_in_passes(monkeypatch):
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 32, 1000, dtype=np.uint64)).astype(np.uint32)
    assert np.array_equal(C.unpack(C.pack(x)), x)
    assert len(C.unpack(C.pack(x[:0]))) == 0
    import pyarrow as pa
    text = "a b c. d e, f g h i\n" * 50
    raw = np.frombuffer(text.encode(), np.uint8)
    data, to, words = C.canonical(raw, np.array([0, len(raw)]))
    assert words.tolist() == [450] and bytes(data[:16]) == b"a b c\nd e\nf g h "
    batch = pa.record_batch({"data": pa.array([bytes(data).decode()]), "lang": pa.array(["en"])})
    whole = np.sort(np.concatenate([p.print for p, *_ in C._runs(batch, 0, 1)]))
    monkeypatch.setattr(C, "PASS_BYTES", 64)
    cut = list(C._runs(batch, 0, 1))
    assert len(cut) > 5
    assert np.array_equal(np.sort(np.concatenate([p.print for p, *_ in cut])), whole)


# ---- conversations

def _every_script(rows):
    """The cheapest (cost, audit) of all scripts with at most three inserts."""
    best = [None]

    def go(i, roles, audit, cost, inserts):
        if best[0] and cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            best[0] = min(best[0] or (cost, audit), (cost, audit))
        if inserts < 3:
            for r in "ua":
                go(i, roles + r, audit + "I", cost + 5, inserts + 1)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, roles, audit + "D", cost + 2, inserts)
            if fault in (0, 3):
                more = 5 if fault == 3 else 0
                go(i + 1, roles + initial, audit + "K", cost + more, inserts)
                for r in "ua":
                    go(i + 1, roles + r, audit + "R", cost + 1 + more, inserts)
    go(0, "", "", 0, 0)
    return best[0]


def test_search_finds_the_cheapest_and_least_script():
    rnd = random.Random(8)
    for _ in range(600):
        rows = [(rnd.choice(["s", "u", "a", "u", "a", "x"]), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(rnd.randint(0, 5))]
        assert cheapest_edits(rows) == _every_script(rows)
    many = [(rnd.choice("sua"), rnd.choice([0, 0, 1, 2, 3])) for _ in range(30_000)]
    cost, audit = cheapest_edits(many)
    assert len(audit) - audit.count("I") == len(many) and cost > 0


def _damaged(rows):
    def name(x):
        return " " if x is None else str(x)

    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        for _ in range(0 if code == 0 else 2 if code == 3 else 1):
            yield conv, turn, role, text


def _plain_repair(rows):
    found = defaultdict(list)
    for conv, turn, role, text in _damaged(rows):
        found[conv].append((turn, role, text))
    out, texts = [], []
    for conv in {r[0] for r in rows}:
        own = sorted(found[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in own:
            body = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = cheapest_edits(list(zip(initials, faults, strict=True)))
        roles, kept, i = "", [], 0
        for edit in audit:
            need = "a" if roles[-1:] == "u" else "u"
            role = initials[i] if edit == "K" else need
            if edit != "D":
                roles += role
                full = own[i][1] if edit == "K" else {"u": "user", "a": "assistant"}[need]
                kept.append((edit, full, "" if edit == "I" else own[i][2]))
            i += edit != "I"
        assert re.fullmatch(r"(s?(ua)+)?", roles)
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(k) for k in (1, 2, 3)), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
                    cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in kept).encode()).hexdigest()))
        texts += [(conv, k, *row) for k, row in enumerate(kept, 1)]
    return sorted(out, key=repr), sorted(texts, key=repr)


def test_repaired_conversations_equal_plain_ones(spark, sf):
    rnd = random.Random(2)
    texts = ["Yes.", "no", " \t\n", "", None, "Is it?", "same text.", "same text.", "é!  \n", " "]
    rows = [(c if c else None, rnd.choice([None, *range(9)]) if c % 3 == 0 else t, rnd.choice(["system", "user", "assistant", "user", "assistant", None, "tool"]), rnd.choice(texts))
            for c in range(150) for t in range(rnd.randint(1, 12))]
    rows += [rows[7]] * 3 + [(900, t, "user" if t % 2 == 0 else "assistant", "x. " * 40_000) for t in range(40)]
    extra = spark.createDataFrame([(*r, "z", 5) for r in rows], "conv_id long, turn long, role string, text string, kind string, audit int").repartition(4)
    real = spark.read.parquet(f"{sf}/conversations.parquet")
    for table in (extra, real):
        own = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
        want, kept = _plain_repair(own)
        got = repair_conversations(damage(table), table)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == want
        assert sorted(map(tuple, repaired_rows(damage(table)).collect()), key=repr) == kept
    gone = [r[0] for r in want if r[7] == ""]
    assert all(r[8] == hashlib.sha256(b"").hexdigest() for r in want if r[0] in gone)
    none = real.limit(0)
    assert repair_conversations(damage(none), none).collect() == []


# ---- token files

def _plain_tokens(docs):
    library = Tokenizer.from_file(VOCABULARY)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = defaultdict(list), 0
    for doc_id, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        out[doc_id].append((ids, start))
        start += len(ids)
    return out, start


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_token_files_give_back_the_ids(spark, odd, sf, table):
    docs = odd if table == "odd" else spark.read.parquet(f"{sf}/documents.parquet")
    want, total = _plain_tokens(docs)
    index = write_token_files(docs, VOCABULARY, 2, length=64, shard_bytes=1 << 16)
    got = read_token_files(index).collect()
    assert sorted(map(repr, (x.id for x in got))) == sorted(repr(k) for k, v in want.items() for _ in v)
    assert sum(r.n_tokens for r in got) == total
    for r in got:
        assert (r.ids in [ids for ids, _ in want[r.id]]) and r.n_tokens == len(r.ids)
        if len(want[r.id]) == 1:
            assert r.start == want[r.id][0][1]
    ends = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))
    for r in digest_token_files(index).collect():
        assert r.ids_crc32 in [zlib.crc32(np.array(ids, "<u4").tobytes()) for ids, _ in want[r.id]]


def test_sequences_are_views_of_equal_length_with_masks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = write_token_files(docs, VOCABULARY, 2, length=32, shard_bytes=1 << 18)
    for row in index.groupBy("file").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect():
        file = TokenFile(row.file)
        n = -(-row.n // 32)
        masks = [file.sequence(i) for i in range(n)]
        assert sum(int(m.sum()) for _, m in masks) == row.n
        assert all(len(ids) == 32 and m.all() for ids, m in masks[:-1])
        ids, _ = file.sequence(0)
        assert not ids.flags.owndata
        assert np.concatenate(list(file.spans(0, row.n))).tolist() == np.concatenate([i[m] for i, m in masks]).tolist()
        file.close()


def test_pieces_give_the_library_ids_for_any_text(monkeypatch):
    import pyarrow as pa
    library = Tokenizer.from_file(VOCABULARY)
    rnd = random.Random(6)
    alphabet = list("abcXYZ .,;:!?'\"<|>-_09\n\t\r éÉß́ 中😀İſ") + ["<|endoftext|>", "<|startoftext|>", "'s", "'RE", "the ", "."]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + [None, "", "x" * 5000, "." * 300]
    every = "".join(chr(c) + rnd.choice([" ", "a", ".", ""]) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000)
    texts += [every[i:i + 500] for i in range(0, len(every), 500)]
    encode = T.Encoder(VOCABULARY)
    assert encode.apart
    for kept in (1 << 19, 50):      # also with a table that is cleared again and again
        monkeypatch.setattr(T, "KEPT_PIECES", kept)
        for a in range(0, len(texts), 400):
            part = texts[a:a + 400]
            ids, first = encode(pa.array(part, pa.string()))
            for i, t in enumerate(part):
                assert ids[first[i]:first[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
    other = T.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.apart
    ids, first = other(pa.array(["Hello  world", None]))
    assert len(ids) == first[1] == first[2] > 0


def test_marks_and_digits_are_pieces_of_their_own():
    """Words met beside other marks and numbers aren't encoded anew, and ids stay the library's."""
    import pyarrow as pa
    library = Tokenizer.from_file(VOCABULARY)
    encode = T.Encoder(VOCABULARY)
    texts = ["river*** river### (river) river=1980 1089", "RIVER's river'98 '5 *'s #'d <river> <|endoftext|>river", "=\u0338 river=\u0338 1\u20e3 9\u0301 *\u0301"]
    ids, first = encode(pa.array(texts[:1]))
    assert set(encode.known) == {"river", "***", "###", "(", ")", "=", *"1089"}
    rnd = random.Random(12)
    texts += ["".join(chr(rnd.randint(33, 126)) for _ in range(12)) for _ in range(2000)]
    ids, first = encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[first[i]:first[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    with open(VOCABULARY, encoding="utf-8") as file:
        vocabulary = json.load(file)
    assert T.apart(vocabulary)
    vocabulary["added_tokens"].append({"content": "<pad-1>"})
    assert not T.apart(vocabulary)


def test_no_rows_give_no_files(nothing):
    index = write_token_files(nothing, VOCABULARY, 2)
    assert index.collect() == [] and digest_token_files(index).collect() == []
