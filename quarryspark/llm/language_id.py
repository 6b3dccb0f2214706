"""Language identification with error-correcting output codes.

Every language gets a codeword of bits; one binary classifier per bit, over byte n-grams,
predicts it. For up to seven languages the codewords are exhaustive (2**(k-1) - 1 bits,
any two of them differ in more than half); beyond that they are random ones of
``10 * ceil(log2 k)`` bits, the best of many draws by their least distance. Decoding is
loss-weighted: a codeword's loss is the weighted mean over the bits of log(1 + exp(-margin)),
a bit's weight being how well its classifier does on each language (Escalera et al.).
The nearest codeword is the prediction; ``score`` is its softmax share and ``ambiguous``
flags a document whose second nearest codeword is about as near.

Features: 1- to 4-grams of the lower-cased UTF-8 bytes, with ASCII characters other than
letters as one blank, hashed to ``dims``; square roots of the counts, at unit length.
The classifiers are logistic regressions, fitted on the driver on a sample bounded by
``sample_rows`` rows (shared evenly by the languages, chosen by a hash of the id); whole
texts are used throughout.

Cases: a text that is null or has no letters is ``und`` with score 0, as is every text
when nothing is labelled; one learned language makes it the prediction with score 1;
repeated rows are predicted alike; other columns are carried along unless they clash with
``lang_pred``, ``score`` or ``ambiguous``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryspark.runtime import extended, give_back, other_columns, quoted

UNDETERMINED = "und"
_BLANKED = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], "uint32")


def ngram_features(texts: list[str], dims: int) -> np.ndarray:
    """A row of ``dims`` features a text."""
    rows = np.empty((len(texts), dims), "float32")
    shift = np.uint32(32 - (dims - 1).bit_length())
    for k, t in enumerate(texts):
        b = np.frombuffer((" " + " ".join(t.lower().encode("utf-8", "replace").translate(_BLANKED).decode("utf-8", "replace").split()) + " ").encode(), "uint8").astype("uint32")
        h, spots = np.zeros(len(b), "uint32"), []
        for n in range(1, 5):
            if len(b) < n:
                break
            h = (h[: len(b) - n + 1] + b[n - 1 :] + np.uint32(n)) * _MULTIPLIERS[n - 1]
            h ^= h >> np.uint32(15)
            spots.append((h * np.uint32(0x2C1B3C6D)) >> shift)
        rows[k] = np.sqrt(np.bincount(np.concatenate(spots), minlength=dims)[:dims])
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return rows


def codewords(k: int, seed: int = 0) -> np.ndarray:
    """k rows of bits -1 and 1."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        numbers = np.arange(2 ** (k - 1) - 1)
        return np.array([np.ones(len(numbers))] + [np.where(numbers >> (k - 2 - r) & 1, 1, -1) for r in range(k - 1)], "float64")
    rng, best, spread = np.random.default_rng(seed), None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (k, 10 * int(np.ceil(np.log2(k)))))
        gram = m @ m.T
        least = (m.shape[1] - (gram - 2 * m.shape[1] * np.eye(k)).max()) / 2
        if least > spread and (np.abs(m.sum(0)) < k).all():
            best, spread = m, least
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # dims x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows add up to 1
    dims: int

    def losses(self, x: np.ndarray) -> np.ndarray:
        f = x @ self.weights + self.bias
        return (np.logaddexp(0, -f[:, None, :] * self.codes[None]) * self.trust[None]).sum(2)


def fit_languages(x: np.ndarray, langs: list[str], dims: int, steps: int = 250, penalty: float = 2e-5) -> LanguageModel:
    names = sorted(set(langs))
    codes = codewords(len(names))
    y = codes[np.searchsorted(names, langs)].astype("float32")
    share = np.bincount(np.searchsorted(names, langs), minlength=len(names))
    per_row = (1.0 / share)[np.searchsorted(names, langs)].astype("float32")[:, None] / max(1, len(names))
    w, b = np.zeros((dims, codes.shape[1]), "float32"), np.zeros(codes.shape[1], "float32")
    v, c, rate = w.copy(), b.copy(), 1 / (0.5 + penalty)
    for step in range(steps):
        g = -per_row * y / (1 + np.exp(np.clip(y * (x @ v + c), -30, 30)))
        nw, nb = v - rate * (x.T @ g + penalty * v), c - rate * g.sum(0)
        m = step / (step + 3)
        v, c, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    right = (np.sign(x @ w + b) == y).astype("float64")
    trust = np.array([right[[lang == n for lang in langs]].mean(0) for n in names]) + 1e-6
    return LanguageModel(names, codes, w, b, trust / trust.sum(1, keepdims=True), dims)


def train_language_id(docs: DataFrame, trainable: Column, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", dims: int = 8192, sample_rows: int = 4000) -> LanguageModel | None:
    """Fit on at most about ``sample_rows`` rows with a language for which ``trainable`` holds; None if there are none.

    Rows are drawn by a hash of id and text, so null and repeated ids make no difference; of
    rows that agree in both, however many, one is drawn or none.
    """
    rows = docs.filter(trainable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    drawn = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.lit("language"), F.col(id_col).cast("string"), F.col(text_col)).alias("spot"))
    # distinct rows as a sketch tells them, a few percent off
    counts = {r[0]: max(1, r[1]) for r in drawn.groupBy("lang").agg(F.approx_count_distinct("spot", 0.03)).collect()}
    if not counts:
        return None
    each = sample_rows / len(counts)
    share = F.element_at(F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))]), F.col("lang"))
    chosen = drawn.filter(F.pmod("spot", F.lit(1 << 30)) / F.lit(float(1 << 30)) < share).groupBy("spot", "lang").agg(F.min("text").alias("text")).select("text", "lang")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(t, lang) for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if any(map(str.isalpha, t))]
            for at in range(0, len(pairs), 64):
                part = pairs[at : at + 64]
                x = ngram_features([t for t, _ in part], dims).astype("float16")
                yield pa.RecordBatch.from_pydict({"x": [zlib.compress(r.tobytes(), 1) for r in x], "lang": [lang for _, lang in part]})
        give_back()

    sample = chosen.mapInArrow(featured, "x binary, lang string").toArrow()
    if not sample.num_rows:
        return None
    langs, rows = sample.column("lang").to_pylist(), sample.column("x")
    order = sorted(range(len(langs)), key=lambda k: (langs[k], zlib.decompressobj().decompress(rows[k].as_buffer(), 256)))
    x = np.empty((len(langs), dims), "float32")
    for at, k in enumerate(order):
        x[at] = np.frombuffer(zlib.decompress(rows[k].as_buffer()), "float16")
    del sample, rows
    return fit_languages(x, [langs[k] for k in order], dims)


def identify_language(docs: DataFrame, model: LanguageModel | None, *, text_col: str = "text", sharpness: float = 6.0, ambiguity: float = 0.02) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous."""
    names = other_columns(docs, ["lang_pred", "score", "ambiguous"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            pred, score, flag = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            known = [k for k, t in enumerate(texts) if m is not None and t and any(map(str.isalpha, t))]
            for at in range(0, len(known), 64):
                part = known[at : at + 64]
                losses = m.losses(ngram_features([texts[k] for k in part], m.dims))
                p = np.exp(-sharpness * (losses - losses.min(1, keepdims=True)))
                p /= p.sum(1, keepdims=True)
                two = np.sort(losses, axis=1)[:, :2]
                for k, row, best, least in zip(part, p, losses.argmin(1), two, strict=True):
                    pred[k], score[k], flag[k] = m.languages[best], row[best], len(least) > 1 and least[1] - least[0] < ambiguity
            columns = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score), pa.array(flag)], names=[*names, "lang_pred", "score", "ambiguous"])
        give_back()

    kept = docs.select(*quoted(list(dict.fromkeys([*names, text_col]))))
    schema = extended(kept.select(*quoted(names)).schema, "lang_pred string, score double, ambiguous boolean")
    return kept.mapInArrow(run, schema)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n
