"""Operators that judge one row at a time: token counts, secrets, decontamination,
language, quality."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from furrow.llm import language, secrets, token_files
from furrow.llm.boosting import fit_boosted
from furrow.llm.common import NOT_SPACE, Words, runs_hash
from furrow.llm.decontaminate import contamination, drop_contaminated
from furrow.llm.language import (
    BITS, Identifier, Model, entropies, fit_identifier, grams, identify_documents, keep_identified, predict_language, symbol_table)
from furrow.llm.quality import fit_quality, score_quality
from furrow.llm.token_counts import length_counter, pieces, token_counts

SPECIAL = {"<|endoftext|>": 50256}


def _rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# ---- words

def test_word_hashes_agree_exactly_with_words():
    rnd = random.Random(1)
    docs = ["".join(rnd.choice(" aAbÉ\n\t-") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    data = [d.encode() for d in docs]
    raw = np.frombuffer(b"".join(data), np.uint8)
    w = Words(raw, np.concatenate(([0], np.cumsum([len(d) for d in data]))), NOT_SPACE)
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    low = [[x for x in re.split(rb"[\x20\x09-\x0D]+", d.translate(lower)) if x] for d in data]
    assert np.diff(w.first).tolist() == [len(x) for x in low]
    seen = {}
    for h, word in zip(w.hash.tolist(), [x for d in low for x in d], strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(runs_hash(w.hash[:3], 5)) == 0


# ---- token counts

@pytest.fixture(scope="module")
def counted(odd):
    return token_counts(odd, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIAL)


def test_token_counts_are_those_of_the_json_library(spark, odd, counted, sf):
    count = length_counter(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(((r.doc_id, len((r.text or "").encode()), count([r.text or ""])[0]) for r in odd.collect()), key=repr)
    assert _rows(counted, "doc_id", "n_bytes", "n_tokens") == want
    by_json = token_counts(odd, public_tokenizers.path("byte_bpe_50k.json"))
    assert _rows(by_json, "doc_id", "n_bytes", "n_tokens") == want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = dict(_rows(token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIAL),
                     "doc_id", "n_tokens"))
    assert got == {r.doc_id: count([r.text or ""])[0] for r in docs.collect()}


def test_rank_file_counts_every_code_point_like_the_library():
    count = length_counter(public_tokenizers.path("byte_bpe_50k.json"))
    ranks = length_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIAL)
    rnd = random.Random(11)
    every = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(c + rnd.choice(["", " ", "a", "1", ".", "'s", "\n"]) for c in every[i:i + 200]) for i in range(0, len(every), 200)]
    assert ranks(texts) == count(texts)


def test_pieces_keep_counts_and_sentencepiece_counts_whole_texts(spark, odd):
    count = length_counter(public_tokenizers.path("byte_bpe_50k.json"))
    for r in odd.collect():
        text = r.text or ""
        cut = pieces(text, 50)
        assert "".join(cut) == text
        assert sum(count(cut)) == count([text])[0]
    model = public_tokenizers.path("piece_bpe_32k.model")
    texts = odd.where(F.length("text") < 10_000)
    want = length_counter(model)
    assert _rows(token_counts(texts, model), "doc_id", "n_tokens") == sorted(
        ((r.doc_id, want([r.text])[0]) for r in texts.collect()), key=repr)


# ---- secrets

_PLAIN = {"assign": re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I),
          "access": re.compile(rb"AKIA[A-Z0-9]+"), "hex": re.compile(rb"[0-9a-f]+"), "pem": re.compile(secrets.RULES["pem"])}


def _plain_spans(data):
    found = []
    for k, (name, rule) in enumerate(_PLAIN.items()):
        for m in rule.finditer(data):
            least = {"assign": 12, "access": 18, "hex": 16, "pem": 0}[name]
            if len(m.group(2) if name == "assign" else m.group()) >= least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_automaton_finds_the_spans_of_plain_regexes():
    matcher = secrets.Matcher(list(secrets.RULES.values()))
    rnd = random.Random(3)
    bits = [b"password", b"Secret", b"token", b"API_KEY", b"apikey", b"=", b":", b" ", b'"', b"'", b"AKIA", b"ABCD1234", b"deadbeef01",
            b"abc", b"xyz", b",", b"\n", b"0123456789abcdef", b"-----BEGIN ", b"RSA ", b"PRIVATE KEY-----", "é".encode()]
    for _ in range(4000):
        data = b"".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))
        assert secrets.find_spans(matcher, data) == _plain_spans(data)


def test_secret_scan_rows_and_redaction(odd, nothing):
    got = {(r.doc_id, r.spans, r.base_sha256) for r in secrets.scan_secrets(odd).collect()}
    kinds = list(_PLAIN)
    for r in odd.collect():
        data = (r.text or "").encode()
        spans = [(len(data[:s].decode()), kinds[k], len(data[:e].decode())) for s, k, e in _plain_spans(data)]
        line = lambda keep: ",".join(f"{k}:{s}:{e}" for s, k, e in spans if k in keep)
        assert (r.doc_id, line(kinds), hashlib.sha256(line(secrets.BASE).encode()).hexdigest()) in got
    masked = secrets.redact_secrets(odd)
    assert masked.schema == odd.schema and masked.count() == odd.count()
    for r in masked.where("doc_id in (16, 17)").collect():
        assert "[secret]" in r.text and not _plain_spans(r.text.encode()) and r.n_chars == len(r.text)
    assert masked.where("text is null").count() == 1
    assert secrets.scan_secrets(nothing).count() == 0


# ---- decontamination

def _plain_contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = split(text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i:i + size]), set()).add(None if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i:i + size])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_dropping_keeps_columns_of_any_name(odd, spark):
    bench = spark.createDataFrame([(None, "one two"), (1, "nothing like it")], "item_id long, text string")
    kept = {r.doc_id: r for r in drop_contaminated(odd.withColumns({"_spans": F.lit("s"), "_ITEMS": F.lit(5)}), bench).collect()}
    assert 12 not in kept and 13 not in kept and len(kept) > 10
    assert all((r._words, r._spans, r._ITEMS) == ("w", "s", 5) for r in kept.values())


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_contamination_against_plain_search(spark, odd, nothing, block):
    texts = [r.text for r in odd.where("doc_id in (5, 9)").distinct().collect()]
    items = [(1, texts[0]), (2, texts[1][30:200]), (3, "One, TWO"), (4, None), (None, "word"), (5, "..."), (6, "word " * 12),
             (6, "word " * 12), (10, "zzz é"), (7, "Ünïcode ç")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(odd, bench, block_bytes=block)
    want = _plain_contamination([(r.doc_id, r.text) for r in odd.collect()], items)
    assert _rows(got, *COLUMNS) == want
    clean = drop_contaminated(odd, bench, block_bytes=block)
    assert clean.schema.names == odd.schema.names
    assert clean.count() == sum(not r[-1] for r in want)
    assert contamination(nothing, bench, block_bytes=block).count() == 0
    assert contamination(odd, bench.limit(0)).where("contaminated or n_items > 0").count() == 0


# ---- language

def test_model_is_a_distribution_and_lookup_matches_recursion():
    table = symbol_table(np.array(sorted(map(ord, "abcdefghijklmnopqrstuvwxyz"))))
    texts = ["abracadabra banana", "abba", "xyz abc"]
    packed, _, _ = grams(texts, table)
    model = Model.fit(*np.unique(packed, return_counts=True), symbols=30)
    for context in sorted({int(p) >> BITS for p in packed}):
        total = np.exp(model.logprob(np.array([(context << BITS) | s for s in range(31)]))).sum()
        assert total == pytest.approx(1.0, abs=1e-9)
    # The recursion, spelled out over tuples of symbols.
    def split(p, n):
        return tuple((p >> (BITS * j)) & ((1 << BITS) - 1) for j in reversed(range(n)))

    counts = Counter(split(int(p), 4) for p in packed)
    orders = [counts]
    while len(next(iter(orders[0]))) > 1:
        orders.insert(0, Counter(g[1:] for g in orders[0]))

    def plain(gram):
        p = 1.0 / 31
        for n, known in enumerate(orders, 1):
            own = gram[4 - n:]
            ones, twos = (sum(v == k for v in known.values()) for k in (1, 2))
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            same = [v for g, v in known.items() if g[:-1] == own[:-1]]
            if same:
                p = max(known[own] - discount, 0) / sum(same) + discount * len(same) / sum(same) * p
        return p

    probe = np.concatenate((np.unique(packed), (packed[:10] & ~((1 << BITS) - 1)) | 7))
    for p, got in zip(probe, np.exp(model.logprob(probe)), strict=True):
        assert got == pytest.approx(plain(split(int(p), 4)), rel=1e-9)


def test_every_letter_has_its_own_symbol():
    letters = np.array(sorted(map(ord, "abc中文字ñß")))
    table = symbol_table(letters)
    assert len(set(table[letters].tolist())) == len(letters) and table[ord("д")] == 1 and table[ord("!")] == 0
    packed, _, n = grams(["中文", "文中"], table)
    assert len(set(packed.tolist())) == 4 and n.tolist() == [2, 2]


def test_counts_are_whole(spark):
    """Grams seen once stay in the models, whatever their number."""
    docs = spark.createDataFrame([(i, f"{'abcdefghij'[i % 10]}q{'klmnopqrst'[i // 10]}z", "en") for i in range(100)], "doc_id long, text string, lang string")
    found = fit_identifier(docs)
    learned = docs.where(F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id").cast("string")), F.lit(10)) != 0)
    packed = np.concatenate([grams([r.text], symbol_table(found.letters))[0] for r in learned.collect()])
    assert np.array_equal(found.models[0].orders[-1][0], np.unique(packed))


def test_language_of_held_out_rows_and_odd_rows(spark, odd, nothing, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    got = identify_documents(docs, held)
    right = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95
    identifier = fit_identifier(docs)
    rows = {(r.doc_id, r.lang_pred): r for r in predict_language(odd, identifier).collect()}
    assert len(predict_language(odd, identifier).collect()) == odd.count()
    for i in range(4):
        r = rows[(i, "und")]
        assert r.score == 0 and r.rejected
    assert all(0 <= r.score <= 1 for r in rows.values())
    kept = keep_identified(docs, identifier)
    assert kept.schema == docs.schema and kept.count() > 0.97 * docs.count()
    strange = spark.createDataFrame([(1, "qxz vvkw zzqj xkcd wvvq qqqq zxzx " * 5, "en", "s", 1)], docs.schema)
    assert keep_identified(strange, identifier).count() == 0
    assert predict_language(nothing, identifier).count() == 0
    assert fit_identifier(nothing).langs == []
    assert {r.lang_pred for r in predict_language(odd, Identifier([], [], np.zeros(0, np.int64))).collect()} == {"und"}


def test_mislabelled_calibration_rows_do_not_loosen_the_rejection():
    rnd = random.Random(3)
    text = lambda letters: " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 6))) for _ in range(80))
    alphabets = ["aaabbcde", "ttuuuvwx"]
    letters = np.array(sorted(map(ord, set("".join(alphabets)))))
    table = symbol_table(letters)
    models = [Model.fit(*np.unique(grams([text(a) for _ in range(200)], table)[0], return_counts=True), 17) for a in alphabets]
    rows = [(text(alphabets[i % 2]), i % 2 if i % 101 else 1 - i % 2) for i in range(2020)]     # 1 % carry the other's label
    identifier = Identifier(["a", "t"], models, letters)
    h, size, _ = entropies(models, [t for t, _ in rows], table)
    identifier.calibrate(h, size, np.array([x for _, x in rows]))
    assert identifier.predict([text("ghijklmn") for _ in range(50)])[2].all()
    assert identifier.predict([t for t, _ in rows])[2].mean() <= 0.002


@pytest.mark.parametrize("langs, some", [(["a", "b"], [0, 1]), (["a", "b", "c"], [0, 1])])
def test_calibration_over_a_table_is_that_over_arrays(spark, langs, some):
    """A rare tail counts too: no row of it may be left out."""
    rnd = np.random.default_rng(6)
    n = 3000
    size, right = rnd.integers(20, 900, n), rnd.choice(some, n)
    h = 3 + rnd.random((n, len(langs)))
    h[np.arange(n), right] = 2 + 0.3 * right + rnd.normal(0, 0.05, n) + rnd.normal(0, 1, n) / np.sqrt(size)
    h[:6, :] += 4
    arrays, table = Identifier(langs, [], np.zeros(0, np.int64)), Identifier(langs, [], np.zeros(0, np.int64))
    arrays.calibrate(h, size, right)
    fit = language._likelihoods(h, right)
    language.calibrate_rows(table, spark.createDataFrame(
        [(int(r), float(h[i, r]), int(size[i]), bool(h[i].argmin() == r), fit[i].tolist()) for i, r in enumerate(right)],
        "lang int, h double, size long, agree boolean, fit array<double>").repartition(5))
    assert table.temperature == arrays.temperature
    np.testing.assert_allclose(table.spread, arrays.spread, rtol=1e-3)
    assert table.bound == pytest.approx(arrays.bound, rel=1e-3)


def test_every_row_that_no_model_is_fitted_on_calibrates(spark, monkeypatch):
    """Far more rows than any sample would hold."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("abab ab b"), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    held_out = docs.where(F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id").cast("string")), F.lit(10)) == 0).count()
    seen = []
    monkeypatch.setattr(language, "calibrate_rows", lambda found, rows: seen.append(rows.count()))
    fit_identifier(docs)
    assert seen == [held_out]


# ---- quality

def test_trees_learn_a_planted_rule_and_traverse_flat_arrays():
    rnd = np.random.default_rng(0)
    x = rnd.random((3000, 5))
    y = ((x[:, 0] > 0.4) ^ (x[:, 3] > 0.7)).astype(float)
    model = fit_boosted(x[:2000], y[:2000], trees=60)
    assert ((model.score(x[2000:]) > 0.5) == (y[2000:] == 1)).mean() > 0.95
    for row, got in zip(x[2000:2050], model.score(x[2000:2050]), strict=True):       # a plain walk of the trees
        margin = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            margin += value[node - len(feature)]
        assert got == pytest.approx(1 / (1 + np.exp(-margin)))
    assert fit_boosted(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    one = fit_boosted(x[:10], np.ones(10))
    assert (one.score(x) > 0.9).all()


def test_quality_of_held_out_and_odd_rows(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit_quality(docs, labels.where(rest != 0))
    seen = (score_quality(docs, model).join(labels.where(rest == 0), "doc_id")
            .agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("int"))).first()[0])
    assert seen > 0.9
    rows = score_quality(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    again = fit_quality(docs, labels.where(rest != 0))
    assert (again.threshold == model.threshold).all() and (again.value == model.value).all()
    blank = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    assert {r.score for r in score_quality(odd, fit_quality(odd, blank)).collect()} == {0.5}
    assert score_quality(nothing, model).count() == 0


def test_known_pieces_are_not_learned_again(monkeypatch):
    encoder = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Some plain words, again some words.", "<s> A<b <unk> x9 ünï", "", "z" * 100 + " again"] * 3
    want = [i for e in encoder.library.encode_batch(texts, add_special_tokens=False) for i in e.ids]
    for times in range(2):
        ids, first = encoder(token_files.pa.array(texts))
        assert ids.tolist() == want and first[-1] == len(want)
        if not times:
            monkeypatch.setattr(encoder, "_learn", lambda pieces: pytest.fail("learned again"))
