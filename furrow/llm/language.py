"""Operator 3: language identification with character language models.

One interpolated Kneser-Ney model of order ``ORDER`` per language. Texts are
lower-cased; every letter of the training texts has a symbol of its own (letters
never seen share one), every run of other characters is one space symbol. Full-order
counts are gathered by Spark over all training rows and all of them enter the models;
the lower orders are continuation counts. The arrays of a model (grams and contexts,
sorted by packed code) grow with the distinct grams of ``ORDER`` symbols that the
corpus holds, not with its rows; the alphabet bounds them. A text gets the language of
least cross-entropy by symbol.

Calibration uses every training row of the tenth (by hash of the id) that no model is
fitted on: the temperature of the score (likelihood of the right language) and the
rejection bound, in standard deviations of the chosen language's cross-entropy at the
text's length, from the rows whose label has the least cross-entropy, so mislabelled rows
don't loosen it: a high quantile, and where the rows are too few for it, the exponential
tail that they have above their median, at ``REJECTED`` of right rows. Sums, medians and
quantiles are Spark aggregates; for quantiles values are rounded to ``DIGITS``, so that an
aggregate holds a bounded number of them.

Defined results: null texts and texts without a letter are ``und``, score 0,
rejected; so is every text where no training row exists; equal cross-entropies go
to the first language by code point; rows with null id or language are scored but
never learned from; repeated rows each give a row and are learned as often; an
empty table gives an empty result; other columns are ignored by
``predict_language`` and kept by ``keep_identified``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import doc_chunks, parts, stage

ORDER = 4
BITS = 15                  # of a symbol: 32,766 letters have their own, more share the one of unseen letters
UNSEEN = 1                 # symbol of letters that no training text holds; 0 is the space
TEMPERATURES = [2.0 ** k for k in range(0, 9)]
DIGITS = 4                 # of cross-entropies and deviations in quantiles
MOST = 100.0               # above which they count as this
BOUND_QUANTILE = 0.999     # of the deviations of calibration rows
REJECTED = 1e-4            # share of right rows that the tail's bound rejects
OUTLIER = 6.0              # robust standard deviations beyond which a row isn't fitted
CHUNK = 1 << 20
PIECE_CHARS = 1 << 20
FLUSH_GRAMS = 1 << 20
UNKNOWN = "und"


def _is_letter(cache={}) -> np.ndarray:  # noqa: B006
    """Of every code point."""
    if "t" not in cache:
        cache["t"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return cache["t"]


def symbol_table(letters: np.ndarray) -> np.ndarray:
    """Symbol of every code point: 0 no letter, else that of ``letters`` (sorted) or ``UNSEEN``."""
    table = np.where(_is_letter(), UNSEEN, 0).astype(np.int64)
    own = letters[:(1 << BITS) - 2]
    table[own] = np.arange(len(own)) + UNSEEN + 1
    return table


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def letters_of(rows: DataFrame, text_col: str) -> np.ndarray:
    """Sorted letters (lower-cased) of all texts; at most one row a code point and task."""
    def find(batches):
        seen = np.zeros(0x110000, dtype=bool)
        for batch in parts(batches, 0):
            for t in batch.column(0).to_pylist():
                seen[_codes([(t or "").lower()])] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen & _is_letter()), pa.int64())], names=["code"])

    found = rows.select(F.col(text_col).cast("string")).mapInArrow(find, "code bigint").distinct().collect()
    return np.array(sorted(r["code"] for r in found), np.int64)


def grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed top-order gram of every symbol, first gram of each text (one more
    entry), number of letters of each text)."""
    low = [t.lower() for t in texts]
    edges = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
    sym = table[_codes(low)]
    before = np.concatenate(([0], sym[:-1])) if len(sym) else sym
    inner = np.ones(len(sym), dtype=bool)
    inner[edges[:-1][edges[:-1] < len(sym)]] = False
    keep = (sym != 0) | ((before != 0) & inner)
    first = np.concatenate(([0], np.cumsum(keep)))[edges]
    letters = np.diff(np.concatenate(([0], np.cumsum(sym != 0)))[edges])
    size = np.diff(first)
    pad = ORDER - 1
    place = np.arange(int(first[-1])) + np.repeat(np.arange(1, len(texts) + 1) * pad, size)
    out = np.zeros(int(first[-1]) + pad * len(texts), np.int64)
    out[place] = sym[keep]
    packed = out[place]
    for j in range(1, ORDER):
        packed |= out[place - j] << (BITS * j)
    return packed, first, letters


@dataclass
class Model:
    """One language: per order (grams, counts, contexts, totals, types, discount)."""

    orders: list[tuple]
    symbols: int

    @classmethod
    def fit(cls, codes: np.ndarray, counts: np.ndarray, symbols: int) -> Model:
        order = np.argsort(codes)
        codes, counts = codes[order], counts[order].astype(np.float64)
        orders = []
        for n in range(ORDER, 0, -1):
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context, at = np.unique(codes >> BITS, return_index=True)
            totals = np.add.reduceat(counts, at) if len(at) else counts
            types = np.diff(np.concatenate((at, [len(codes)]))).astype(np.float64)
            orders.append((codes, counts, context, totals, types, discount))
            codes, counts = np.unique(codes & ((1 << (BITS * (n - 1))) - 1), return_counts=True)
            counts = counts.astype(np.float64)
        return cls(orders[::-1], symbols)

    def logprob(self, codes: np.ndarray) -> np.ndarray:
        """Natural log of the interpolated probability of each top-order gram."""
        p = np.full(len(codes), 1.0 / (self.symbols + 1))
        for n, (known, counts, context, totals, types, discount) in enumerate(self.orders, 1):
            gram = codes & ((1 << (BITS * n)) - 1)
            c = _lookup(known, counts, gram)
            total = _lookup(context, totals, gram >> BITS)
            seen = total > 0
            safe = np.where(seen, total, 1.0)
            mass = discount * _lookup(context, types, gram >> BITS) / safe
            p = np.where(seen, np.maximum(c - discount, 0.0) / safe + mass * p, p)
        return np.log(p)


def _lookup(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x))
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return np.where(keys[at] == x, values[at], 0.0)


def _pieces(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Texts cut to at most PIECE_CHARS, and the text each piece belongs to."""
    out, owner = [], []
    for i, t in enumerate(texts):
        for at in range(0, max(len(t), 1), PIECE_CHARS):
            out.append(t[at:at + PIECE_CHARS])
            owner.append(i)
    return out, np.array(owner, np.int64)


def entropies(models: list[Model], texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts x models cross-entropy by symbol, symbols, letters of each text)."""
    pieces, owner = _pieces(texts)
    total, size, letters = np.zeros((len(texts), len(models))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    sizes = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    for a, b in doc_chunks(sizes, CHUNK):
        packed, first, n = grams(pieces[a:b], table)
        np.add.at(letters, owner[a:b], n)
        np.add.at(size, owner[a:b], np.diff(first))
        unique, at = np.unique(packed, return_inverse=True)
        for m, model in enumerate(models):
            run = np.concatenate(([0.0], np.cumsum(model.logprob(unique)[at])))
            np.add.at(total[:, m], owner[a:b], np.diff(run[first]))
    return -total / np.maximum(size, 1)[:, None], size, letters


def _counted(rows: DataFrame, lang_col: str, text_col: str, letters: np.ndarray) -> DataFrame:
    """(lang, gram, n): top-order counts over all ``rows``."""

    def count(batches):
        table = symbol_table(letters)
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            for lang, (codes, n) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())],
                    names=["lang", "gram", "n"])
            held.clear()

        for batch in parts(batches, 1):
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own, _ = _pieces([texts[i] or "" for i in np.flatnonzero(langs == lang)])
                sizes = np.concatenate(([0], np.cumsum([len(p) for p in own])))
                for a, b in doc_chunks(sizes, CHUNK):
                    codes, n = np.unique(grams(own[a:b], table)[0], return_counts=True)
                    if lang in held:
                        both = np.concatenate((held[lang][0], codes))
                        weight = np.concatenate((held[lang][1], n))
                        codes, at = np.unique(both, return_inverse=True)
                        n = np.bincount(at, weight, len(codes)).astype(np.int64)
                    held[lang] = codes, n
                if sum(len(c) for c, _ in held.values()) > FLUSH_GRAMS:
                    yield from flush()
        yield from flush()

    return (rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string"))
            .mapInArrow(count, "lang string, gram bigint, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


@dataclass
class Identifier:
    """Languages, their models, the letters that have a symbol, and the calibration."""

    langs: list[str]
    models: list[Model]
    letters: np.ndarray
    temperature: float = 10.0
    spread: list[tuple[float, float, float]] | None = None    # by language: mean, variance, variance by 1/symbols
    bound: float = float("inf")

    def predict(self, texts: list[str], cache={}):  # noqa: B006
        """(language, score, rejected) lists."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        key = self.letters.tobytes()
        if key not in cache:
            cache.clear()
            cache[key] = symbol_table(self.letters)
        h, size, letters = entropies(self.models, texts, cache[key])
        best = h.argmin(axis=1)
        low = h[np.arange(len(texts)), best]
        score = 1.0 / np.exp(-self.temperature * (h - low[:, None])).sum(axis=1)
        rejected = self.deviation(low, best, size) > self.bound
        none = letters == 0
        return ([UNKNOWN if x else self.langs[b] for x, b in zip(none, best, strict=True)],
                np.where(none, 0.0, score), rejected | none)

    def deviation(self, h, lang, size):
        if not self.spread:
            return np.zeros(len(h))
        mean, fixed, by_size = np.array(self.spread).T[:, lang]
        return (h - mean) / np.sqrt(fixed + by_size / np.maximum(size, 1))

    def calibrate(self, h: np.ndarray, size: np.ndarray, right: np.ndarray) -> None:
        """From cross-entropies, symbols and right languages of rows with letters."""
        if not len(h):
            return
        self.temperature = TEMPERATURES[int(_likelihoods(h, right).sum(axis=0).argmax())]
        agree = h.argmin(axis=1) == right
        if agree.any():
            h, size, right = h[agree], size[agree], right[agree]
        self.spread = []
        for m in range(len(self.langs)):
            mine, n = h[right == m, m], size[right == m]
            if not len(mine):
                mine, n = h[np.arange(len(h)), right], size
            usual = _usual(mine, n)
            mine, n = mine[usual], n[usual]
            mean = float(np.average(mine, weights=n))
            square = (mine - mean) ** 2
            design = np.column_stack((np.ones(len(n)), 1.0 / n))
            fit = np.linalg.lstsq(design, square, rcond=None)[0] if len(n) > 2 else np.array([0.0, 1.0])
            self.spread.append((mean, max(float(fit[0]), 1e-3), max(float(fit[1]), 1.0)))
        away = self.deviation(h[np.arange(len(h)), right], right, size)
        middle = float(np.median(away))
        excess = away[away > middle] - middle
        tail = middle + (float(excess.mean()) if len(excess) else 1.0) * np.log(0.5 / REJECTED)
        self.bound = max(float(np.quantile(away, BOUND_QUANTILE, method="higher")), tail)


def _likelihoods(h: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(rows x temperatures) log likelihood of the right language."""
    gap = h - h.min(axis=1, keepdims=True)
    own = gap[np.arange(len(h)), right]
    return np.column_stack([-t * own - np.log(np.exp(-t * gap).sum(axis=1)) for t in TEMPERATURES])


def _usual(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows not far from the median, both as they are and at their length."""
    away = np.abs(h - np.median(h))
    keep = np.zeros(len(h), bool)
    for x in (away, away * np.sqrt(size)):
        keep |= x <= OUTLIER * 1.4826 * np.median(x)
    return keep


def _median(value):
    return F.percentile(F.round(F.least(value, F.lit(MOST)), DIGITS), F.lit(0.5))


def calibrate_rows(identifier: Identifier, seen: DataFrame) -> None:
    """``Identifier.calibrate`` as aggregates over a table (lang: index of the right language,
    h: its cross-entropy, size: symbols, agree: whether h is the least one, fit: log
    likelihoods by temperature)."""
    total = seen.agg(F.count("*").alias("n"), F.sum(F.col("agree").cast("int")).alias("agree"),
                     *(F.sum(F.col("fit")[i]).alias(f"t{i}") for i in range(len(TEMPERATURES)))).first()
    if not total["n"]:
        return
    identifier.temperature = TEMPERATURES[int(np.argmax([total[f"t{i}"] for i in range(len(TEMPERATURES))]))]
    rows = (seen.where("agree") if total["agree"] else seen).select("lang", "h", F.col("size").cast("double").alias("size"))
    # A language without rows takes all of them; it is -1 here.
    there = {r["lang"] for r in rows.select("lang").distinct().collect()}
    whole = rows if len(there) == len(identifier.langs) else rows.union(rows.select(F.lit(-1), "h", "size"))

    def by_lang(name: str, of: dict[int, float]):
        return F.element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), F.col("lang")).alias(name)

    middle = {r["lang"]: r["m"] for r in whole.groupBy("lang").agg(_median(F.col("h")).alias("m")).collect()}
    away = whole.select("*", F.abs(F.col("h") - by_lang("m", middle)).alias("away"))
    wide = {r["lang"]: r for r in away.groupBy("lang").agg(
        _median(F.col("away")).alias("a"), _median(F.col("away") * F.sqrt("size")).alias("b")).collect()}
    far = OUTLIER * 1.4826
    # Rounding may take a little from a median; equal values must stay within it.
    usual = away.where((F.col("away") <= by_lang("a", {k: far * r["a"] + 10.0 ** -DIGITS for k, r in wide.items()}))
                       | (F.col("away") * F.sqrt("size") <= by_lang("b", {k: far * r["b"] + 10.0 ** -DIGITS for k, r in wide.items()})))
    mean = {r["lang"]: r["m"] for r in usual.groupBy("lang").agg((F.sum(F.col("h") * F.col("size")) / F.sum("size")).alias("m")).collect()}
    square, rest = F.pow(F.col("h") - by_lang("m", mean), F.lit(2.0)), 1 / F.col("size")
    sums = {r["lang"]: r for r in usual.groupBy("lang").agg(
        F.count("*").cast("double").alias("n"), F.sum(rest).alias("x"), F.sum(rest * rest).alias("xx"),
        F.sum(square).alias("y"), F.sum(square * rest).alias("xy")).collect()}
    spread = {}
    for k, r in sums.items():
        fit = (np.linalg.lstsq(np.array([[r["n"], r["x"]], [r["x"], r["xx"]]]), np.array([r["y"], r["xy"]]), rcond=None)[0]
               if r["n"] > 2 else np.array([0.0, 1.0]))
        spread[k] = (mean[k], max(float(fit[0]), 1e-3), max(float(fit[1]), 1.0))
    identifier.spread = [spread.get(m, spread.get(-1)) for m in range(len(identifier.langs))]
    of = {k: identifier.spread[k] for k in there}
    deviation = ((F.col("h") - by_lang("m", {k: x[0] for k, x in of.items()}))
                 / F.sqrt(by_lang("v", {k: x[1] for k, x in of.items()}) + by_lang("s", {k: x[2] for k, x in of.items()}) / F.col("size")))
    away = rows.select(F.round(F.greatest(F.least(deviation, F.lit(MOST)), F.lit(-MOST)), DIGITS).alias("away"))
    n = total["agree"] or total["n"]
    high = np.ceil(BOUND_QUANTILE * (n - 1)) / max(n - 1, 1)        # an entry, not between two
    ends = away.agg(F.percentile("away", F.lit(0.5)).alias("m"), F.percentile("away", F.lit(float(high))).alias("q")).first()
    excess = away.where(F.col("away") > ends["m"]).agg(F.avg(F.col("away") - F.lit(ends["m"]))).first()[0]
    tail = ends["m"] + (1.0 if excess is None else excess) * np.log(0.5 / REJECTED)
    identifier.bound = max(float(ends["q"]), float(tail))


def fit_identifier(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Identifier:
    """Learn from all ``rows`` with a language: nine tenths give the models, one tenth the calibration."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    part = F.pmod(F.xxhash64(F.lit("calibrate"), F.col(id_col).cast("string")), F.lit(10))
    letters = letters_of(rows.where(part != 0), text_col)
    kept = _counted(rows.where(part != 0), lang_col, text_col, letters).toPandas()
    langs = sorted(kept["lang"].unique())
    models = [Model.fit(x["gram"].to_numpy(np.int64), x["n"].to_numpy(np.int64), len(letters) + 1)
              for x in (kept[kept["lang"] == lang] for lang in langs)]
    found = Identifier(langs, models, letters)
    if not langs:
        return found

    def measure(batches):
        table = symbol_table(letters)
        for batch in parts(batches, 1):
            right = np.array([langs.index(x) for x in batch.column(0).to_pylist()], np.int64)
            h, size, n = entropies(models, [t or "" for t in batch.column(1).to_pylist()], table)
            right, h, size = right[n > 0], h[n > 0], size[n > 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(right, pa.int32()), pa.array(h[np.arange(len(h)), right]), pa.array(size, pa.int64()),
                 pa.array(h.argmin(axis=1) == right), pa.array(list(_likelihoods(h, right)), pa.list_(pa.float64()))],
                names=["lang", "h", "size", "agree", "fit"])

    held_out = (rows.where((part == 0) & F.col(lang_col).cast("string").isin(langs))
                .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")))
    calibrate_rows(found, stage(held_out.mapInArrow(measure, "lang int, h double, size bigint, agree boolean, fit array<double>"),
                                "calibration"))
    return found


def predict_language(docs: DataFrame, identifier: Identifier, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row of ``docs``."""

    def predict(batches):
        for batch in parts(batches, 1):
            langs, score, rejected = identifier.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=[id_col, "lang_pred", "score", "rejected"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(predict, schema)


def keep_identified(docs: DataFrame, identifier: Identifier, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the identifier doesn't reject, all columns kept."""
    at = docs.columns.index(text_col)

    def keep(batches):
        for batch in parts(batches, at):
            rejected = identifier.predict([t or "" for t in batch.column(at).to_pylist()])[2]
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(keep, docs.schema)


def identify_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang") -> DataFrame:
    """Fit on the rows for which ``held_out`` is false and score all rows."""
    identifier = fit_identifier(docs.where(~held_out), id_col, text_col, lang_col)
    return predict_language(docs, identifier, id_col, text_col).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
