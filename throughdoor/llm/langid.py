"""Language identification: multinomial naive Bayes on hashed character n-grams.

Texts are lower-cased and everything but letters becomes a space. Counts of
n-grams by language are added up over the training rows; the matrix of
log-probabilities has a fixed number of rows and goes to the tasks with the
scoring function.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from throughdoor.llm import words
from throughdoor.llm.stored import bounded
from throughdoor.llm.words import mix

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    sizes: tuple = (1, 2, 3)
    rows_per_language: int = 5_000  # bound of the rows that the fit may see
    smoothing: float = 0.5
    evidence: float = 40.0  # n-grams count as at most so many independent ones
    matrix_bytes: int = 64 << 20  # bound of the matrix that goes to the tasks


_SALT = mix(np.arange(1, 9, dtype=np.uint64))


def grams(texts: list[str], use: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, their bounds by text, and whether each text has a letter.

    ``texts`` hold letters and spaces only. A text is read as if spaces stood
    around it; n-grams that are all space are left out.
    """
    gap = " " * max(use.sizes)
    joined = gap + gap.join(texts) + gap
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = codes != 32
    codes = codes.astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = len(gap) + np.concatenate([[0], np.cumsum(lengths + len(gap))])[:-1]
    seen = np.concatenate([[0], np.cumsum(is_letter)])
    has_letter = seen[begin + lengths] > seen[begin]
    # one run of positions per text: from the space before its first character
    keep, marks = [], []
    for n in use.sizes:
        code = codes[: len(codes) - n + 1] * _SALT[0]
        some = is_letter[: len(codes) - n + 1].copy()
        for k in range(1, n):
            code = (code ^ (code >> np.uint64(31))) * _SALT[1] + codes[k: len(codes) - n + 1 + k] * _SALT[0]
            some |= is_letter[k: len(codes) - n + 1 + k]
        at = np.flatnonzero(some)
        keep.append((mix(code[at] + _SALT[n]) % np.uint64(use.buckets)).astype(np.int64))
        marks.append(np.searchsorted(at, np.append(begin - n, len(codes))))
    # texts' n-grams of every size side by side
    out = [g[a:b] for i in range(len(texts)) for g, m in zip(keep, marks) for a, b in [(m[i], m[i + 1])]]
    counts = sum((np.diff(m) for m in marks), np.zeros(len(texts), np.int64))
    return (np.concatenate(out) if out else np.zeros(0, np.int64),
            np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), has_letter)


def _slices(column: pa.Array, chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column, about ``chars`` at a time; null is empty.

    Lower-cased, with every run of other characters than letters as one space.
    """
    lower = pc.utf8_lower(column.cast(pa.string()).fill_null(""))
    texts = pc.replace_substring_regex(lower, r"\PL+", " ").to_pylist()
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield first, texts[first: i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # (buckets, languages)
    prior: np.ndarray
    settings: Settings

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of every text.

        A text's distinct n-grams and their counts pick rows of the matrix. The
        score is the posterior of the best language, with the n-grams of a text
        counted as at most ``evidence`` ones: neighbouring n-grams say much the
        same thing. Ties go to the first language by code point.
        """
        use, names, scores = self.settings, [], []
        for _, texts in _slices(column):
            flat, bounds, has_letter = grams(texts, use)
            for i in range(len(texts)):
                if not self.languages or not has_letter[i]:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                counts = np.bincount(flat[bounds[i]: bounds[i + 1]], minlength=use.buckets)
                at = np.flatnonzero(counts)
                total = counts[at] @ self.logp[at]
                n = bounds[i + 1] - bounds[i]
                z = self.prior + total * min(1.0, use.evidence / n)
                p = np.exp(z - z.max())
                best = int(z.argmax())
                names.append(self.languages[best])
                scores.append(float(p[best] / p.sum()))
        return names, np.array(scores, dtype=np.float64)


def train(rows: DataFrame, use: Settings = Settings()) -> Model:
    """Fit on ``rows`` (key, text, lang): at most ``rows_per_language`` of each language.

    All rows are counted for the priors. Rows enter the n-gram counts by a hash
    of ``key``, at a rate that each language's count gives. Rows with a null
    language are left out. A matrix over ``matrix_bytes`` is refused.
    """
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    most = use.matrix_bytes // (8 * use.buckets)
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} languages: the matrix would exceed {use.matrix_bytes} bytes")
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return Model([], np.zeros((use.buckets, 0)), np.zeros(0), use)
    of = {r["lang"]: r["n"] for r in found}
    n = np.array([of[x] for x in languages], dtype=np.float64)
    part = (F.xxhash64("key") % 1_000_003 + 1_000_003) % 1_000_003
    taken = F.lit(False)
    for x in languages:
        rate = min(1.0, use.rows_per_language / of[x])
        taken = taken | ((F.col("lang") == x) & (part < int(rate * 1_000_003) + 1))

    @words.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), use.buckets), dtype=np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            lang = batch.column(0).to_pylist()
            for first, texts in _slices(batch.column(1)):
                flat, bounds, _ = grams(texts, use)
                which = np.array([place[x] for x in lang[first: first + len(texts)]], dtype=np.int64)
                cells = flat + np.repeat(which, np.diff(bounds)) * use.buckets
                counts += np.bincount(cells, minlength=counts.size).reshape(counts.shape)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], names=["cell", "n"])

    sums = (rows.where(taken).select("lang", "text").mapInArrow(run, "cell long, n long")
            .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(len(languages) * use.buckets)
    counts[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    counts = counts.reshape(len(languages), use.buckets) + use.smoothing
    logp = np.log(counts / counts.sum(axis=1, keepdims=True)).T
    return Model(languages, np.ascontiguousarray(logp), np.log(n / n.sum()), use)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``rows`` rows, so that few texts are unpacked at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (replacing columns of those names)."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = names.index(text)
    schema = T.StructType([docs.schema[c] for c in names] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @words.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            lang, score = model.predict(part.column(at))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.select(*names).mapInArrow(run, schema)


def held_out(key):
    """Rows whose key's CRC-32 leaves 2 modulo 4; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, use: Settings = Settings()) -> Model:
    """The model of the documents (doc_id, text, lang) that are not held out."""
    bounded(docs.sparkSession)
    rows = docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang")
    return train(rows, use)


def identified(docs: DataFrame, use: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    A text that is null or has no letter is ``und`` with score 0, as is every
    text if there is nothing to learn from.
    """
    model = learn(docs, use)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def accepted(docs: DataFrame, least_score: float = 0.5, use: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with ``least_score`` or more; same columns."""
    model = learn(docs, use)
    at = docs.columns.index("text")

    @words.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            lang, score = model.predict(part.column(at))
            good = (score >= least_score) & (np.array(lang, dtype=object) != UNKNOWN)
            yield part.filter(pa.array(good.astype(bool)))

    return docs.mapInArrow(run, docs.schema)
