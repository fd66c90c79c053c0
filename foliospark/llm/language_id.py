"""Language identification with string kernels.

Two texts are as similar as their sets of character 1- to 3-grams overlap (blended-spectrum
presence kernel, normalised). Kernel ridge regression, one language against the rest, is solved
in the span of a few landmark texts (Nyström). A text's scores are two matrix products: its
n-gram presence with the landmarks', and the kernel values with the solved weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: N-grams of letters of any script are told apart by a hash of this many bits.
_BITS = 18
N_GRAMS = 1 << _BITS
RESULT = "struct<lang_pred: string, score: double>"

_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Each character's lower-case letter, 0 for all that are none."""
    global _table
    if _table is None:
        low = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low[cp] = ord(c.lower()[0])
        _table = low
    return _table


_FACTORS = [np.array(f, np.uint32) for f in ((0x9E3779B1,), (0x85EBCA77, 0xC2B2AE3D), (0x27D4EB2F, 0x165667B1, 0xD3A2646D))]


def presence(text: str, into: np.ndarray) -> bool:
    """Marks the text's n-grams in ``into`` (N_GRAMS, of zeros); false if it has no letter."""
    code = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not code.any():
        return False
    for factors in _FACTORS:
        n = len(code) - len(factors) + 1
        if n > 0:
            mixed = code[:n] * factors[0]
            for i in range(1, len(factors)):
                mixed = (mixed ^ mixed >> np.uint32(15)) * factors[0] + code[i : i + n] * factors[i]
            into[(mixed ^ mixed >> np.uint32(16)) * np.uint32(0x7FEB352D) >> np.uint32(32 - _BITS)] = True
    return True


@dataclass
class KernelModel:
    languages: list[str]
    vocabulary: np.ndarray  # n-grams of the landmarks
    landmarks: np.ndarray  # n-gram presence by landmark, each divided by the root of its own count
    weights: np.ndarray  # landmark by language
    bias: np.ndarray

    def scores(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """From presence over the vocabulary (texts by n-grams) and the texts' numbers of n-grams."""
        kernel = (found @ self.landmarks) / np.sqrt(np.maximum(counts, 1))[:, None]
        return kernel @ self.weights + self.bias


def fit(rows: list[tuple[str, np.ndarray]], landmarks_per_language: int = 32, ridge: float = 1e-3) -> KernelModel | None:
    """From (language, sorted n-gram codes) of the training texts; None without any."""
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    chosen = [codes for lang in languages for codes in [c for x, c in rows if x == lang][:landmarks_per_language]]
    vocabulary = np.unique(np.concatenate(chosen))

    def matrix(all_codes: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(all_codes), len(vocabulary)), np.float32)
        for i, codes in enumerate(all_codes):
            out[i, np.searchsorted(vocabulary, codes[np.isin(codes, vocabulary)])] = 1
        return out

    landmarks = (matrix(chosen) / np.sqrt([[len(c)] for c in chosen])).T.astype(np.float32)
    among = landmarks.T.astype(np.float64) @ landmarks
    values, vectors = np.linalg.eigh(among)
    good = values > 1e-8 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    width = root.shape[1] + 1
    normal, target = np.eye(width) * ridge * len(rows), np.zeros((width, len(languages)))
    normal[-1, -1] = 1e-9
    for lo in range(0, len(rows), 256):  # normal equations are summed, so that only some rows are dense at a time
        part = rows[lo : lo + 256]
        k = (matrix([c for _, c in part]) @ landmarks).astype(np.float64) / np.sqrt([[len(c)] for _, c in part])
        z = np.c_[k @ root, np.ones(len(part))]
        y = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in part])
        normal += z.T @ z
        target += z.T @ y
    solved = np.linalg.solve(normal, target)
    return KernelModel(languages, vocabulary, landmarks, (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32))


def predict(model: KernelModel | None, texts: list[str | None], group: int = 64) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return names, scores
    space = np.zeros(N_GRAMS, bool)
    for lo in range(0, len(texts), group):
        part = texts[lo : lo + group]
        found = np.zeros((len(part), len(model.vocabulary)), np.float32)
        counts = np.zeros(len(part))
        for i, text in enumerate(part):
            if text and presence(text, space):
                found[i] = space[model.vocabulary]
                counts[i] = np.count_nonzero(space)
            space[:] = False
        values = model.scores(found, counts)
        for i in np.flatnonzero(counts).tolist():
            best = int(values[i].argmax())
            names[lo + i], scores[lo + i] = model.languages[best], float(min(1, max(0, (values[i, best] + 1) / 2)))
    return names, scores


def held_out(doc_id: Column) -> Column:
    """A quarter of the ids, by checksum; a null id is not held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    space = np.zeros(N_GRAMS, bool)
    for batch in batches:
        langs, order, codes = [], [], []
        for lang, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if presence(text, space):
                langs.append(lang)
                order.append(key)
                codes.append(np.flatnonzero(space).astype(np.int32).tobytes())
            space[:] = False
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(order, pa.int64()), pa.array(codes, pa.binary())], names=["lang", "key", "codes"])


def train(docs: DataFrame, per_language: int = 300, landmarks_per_language: int = 32, max_languages: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KernelModel | None:
    """Fits on ``per_language`` rows of each language at most, those of the least hashed ids.

    Rows that are held out, or whose language or text is null, or whose text has no letter, are
    not learned from; of rows that repeat an id one is used. The rows' texts stay on the
    executors; the driver gets their n-gram sets (N_GRAMS bits at most). More than
    ``max_languages`` languages are an error.
    """
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    keyed = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("doc_id"), F.shiftrightunsigned(F.xxhash64(F.lit("train"), id_col), 1).alias("key"))
    sizes = {row["lang"]: row["count"] for row in keyed.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    # Hashes below a language's share leave several times the rows wanted, so tasks send few, however many there are.
    below = F.lit(None).cast("long")
    for lang, n in sorted(sizes.items()):
        below = F.when(F.col("lang") == lang, F.lit(min((1 << 63) - 1, (8 * per_language + 1000) * (1 << 63) // n))).otherwise(below)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id")).alias("place")
    chosen = keyed.filter(F.col("key") <= below).select("*", first).filter(F.col("place") <= per_language).select("lang", "key", "doc_id").distinct()
    chosen = F.broadcast(chosen.select("lang", "key", F.col("doc_id").alias("chosen_id")))  # per_language * max_languages rows at most
    texts = usable.select(F.col(lang_col).cast("string").alias("own_lang"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(chosen, (F.col("doc_id") == F.col("chosen_id")) & (F.col("own_lang") == F.col("lang"))).select("lang", "key", "text")
    coded = rows.mapInArrow(_codes, "lang string, key long, codes binary").collect()
    by_key = {(r["lang"], r["key"]): bytes(r["codes"]) for r in sorted(coded, key=lambda r: (r["lang"], r["key"], bytes(r["codes"])), reverse=True)}
    return fit([(lang, np.frombuffer(codes, np.int32)) for (lang, _), codes in sorted(by_key.items())], landmarks_per_language)


def language_column(docs: DataFrame, model: KernelModel | None, text_col: str = "text") -> Column:
    """struct(lang_pred, score) of every whole text: ``und`` and 0 for null texts and those without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # landmarks times their n-grams, bounded by the parameters of train

    @F.arrow_udf(RESULT)
    def identify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            names, scores = predict(shared.value, batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return identify(F.col(text_col))


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (0 to 1).

    Learns as ``train`` says and predicts from the text alone. Without anything to learn from,
    all rows are ``und`` with score 0. Repeated rows get the same prediction; null ids are
    carried along; an empty table gives an empty result; other columns are ignored.
    """
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **limits)
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), language_column(docs, model, text_col).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
