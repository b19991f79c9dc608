"""Language identification by hyperdimensional profiles.

Every letter of Unicode has its own random vector of +1 and -1, made from a seed and its code point.
A letter n-gram is bound by multiplying its letters' vectors, each rotated by its place; a text is
the bundle (sum) of its n-grams' vectors. A language's prototype is the bundle of all its training
n-grams; a text takes the language whose prototype has the largest cosine with it.

Bundling is linear, so training sums vectors: each task holds one vector for each language it meets,
and what leaves it is as large as that, whatever the number of documents, letters or n-grams.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.base import map_rows, release, small_batches, table, texts

ORDER = 3
DIMENSIONS = 1024
SEED = 20
#: Bits of a code point in an n-gram's code; 0 stands for everything that is no letter.
BITS = 21
#: Letters whose vectors a worker holds, and n-grams that are bound together; a batch of n-grams never
#: has more letters than are held.
HELD, TOGETHER = 8192, 1024
#: Symbols that training gathers for a language before it bundles their n-grams.
GATHERED = 1 << 20


@functools.lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text's letters, with runs of anything else as one 0, and one at
    either end."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.zeros(len(points) + 2, np.int64)
    out[1:-1] = np.where(_is_letter()[points], points, 0)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def codes_of(text: str) -> np.ndarray:
    """Codes of a text's n-grams, in order; none without a letter."""
    s = symbols(text)
    if len(s) < ORDER or not s.any():
        return np.zeros(0, np.int64)
    return s[:-2] << 2 * BITS | s[1:-1] << BITS | s[2:]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a text and their counts; none without a letter."""
    return np.unique(codes_of(text), return_counts=True)


def letter_vector(point: int) -> np.ndarray:
    """Vector of a code point: bits of a hash of the seed and the code point."""
    told = hashlib.shake_128(f"{SEED}-{point}".encode()).digest(DIMENSIONS // 8)
    return (2 * np.unpackbits(np.frombuffer(told, np.uint8)).astype(np.int8) - 1).astype(np.int8)


class _Letters:
    """Vectors of the letters met, in the rotations of each place; begun anew when it is full."""

    def __init__(self):
        self.row = np.full(0x110000, -1, np.int32)
        self.n = 0
        self.turned = [np.zeros((64, DIMENSIONS), np.int8) for _ in range(ORDER)]

    def rows(self, points: np.ndarray) -> np.ndarray:
        found = self.row[points]
        if found.size and found.min() < 0:
            new = np.unique(points[found < 0])
            if self.n + len(new) > HELD:
                self.row[:] = -1
                self.n, new = 0, np.unique(points)
            while self.n + len(new) > len(self.turned[0]):
                self.turned = [np.concatenate([t, np.zeros_like(t)]) for t in self.turned]
            for p in new.tolist():
                v = letter_vector(p)
                for place in range(ORDER):
                    self.turned[place][self.n] = np.roll(v, ORDER - 1 - place)
                self.row[p] = self.n
                self.n += 1
            found = self.row[points]
        return found


@functools.lru_cache(maxsize=1)
def _letters() -> _Letters:
    return _Letters()


def bind(codes: np.ndarray) -> np.ndarray:
    """Vectors of at most TOGETHER n-gram codes: the product of the letters' vectors, rotated by 2, 1
    and 0."""
    held, mask = _letters(), (1 << BITS) - 1
    rows = held.rows(np.stack([codes >> 2 * BITS, codes >> BITS & mask, codes & mask]))
    out = held.turned[0][rows[0]]
    for place in range(1, ORDER):
        out *= held.turned[place][rows[place]]
    return out


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the n-grams' vectors, a bounded number of them at a time; whole numbers."""
    out = np.zeros(DIMENSIONS, np.float64)
    for at in range(0, len(codes), TOGETHER):
        out += counts[at : at + TOGETHER].astype(np.float32) @ bind(codes[at : at + TOGETHER]).astype(np.float32)
    return out


class Profiles:
    """Language prototypes of unit length; what an executor needs to classify texts."""

    def __init__(self, sums: dict[str, np.ndarray]):
        self.names = sorted(sums)
        rows = [sums[n] / max(float(np.linalg.norm(sums[n])), 1e-12) for n in self.names]
        self.matrix = np.array(rows, np.float32).reshape(len(rows), DIMENSIONS)

    def classify(self, text: str | None) -> tuple[str, float]:
        """Language and score: the cosine with its prototype, at least 0; 0 for ``und``."""
        if not text or not self.names:
            return "und", 0.0
        codes, counts = ngrams(text)
        if not len(codes):
            return "und", 0.0
        v = bundle(codes, counts).astype(np.float32)
        cosines = self.matrix @ (v / max(float(np.linalg.norm(v)), 1e-12))
        best = int(np.argmax(cosines))
        return self.names[best], float(np.clip(cosines[best], 0, 1))


def held_out(id_col: str, folds: int, fold: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Profiles:
    """Prototypes from all rows with text and language.

    Each task gathers n-grams of a language, bundles them and emits one vector of whole numbers for
    each language it met; vectors are added in two steps, first dealt over several tasks for each
    language. Shuffled: languages x tasks x 8 KB. The driver gets one vector for each language, which
    is the model itself. Null and letterless texts and null languages teach nothing.
    """

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        total = 0

        def settle(lang: str) -> None:
            nonlocal total
            total -= size.pop(lang)
            codes, counts = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            sums[lang] = sums.get(lang, 0) + bundle(codes, counts)

        for lang, text in feed:
            codes = codes_of(text)
            for at in range(0, len(codes), GATHERED):
                part = codes[at : at + GATHERED]
                if size.get(lang, 0) + len(part) > GATHERED:
                    settle(lang)
                waiting.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part)
                total += len(part)
                if total > 4 * GATHERED:
                    settle(max(size, key=size.get))
            if len(sums) > 2048:
                yield from ((lang, v.tolist()) for lang, v in sums.items())
                sums.clear()
        for lang in list(waiting):
            settle(lang)
        yield from ((lang, v.tolist()) for lang, v in sums.items())

    def add(feed: Iterator[tuple]) -> Iterator[tuple]:
        held, total = None, np.zeros(DIMENSIONS)
        for lang, *_, v in feed:
            if lang != held and held is not None:
                yield held, total.tolist()
                total = np.zeros(DIMENSIONS)
            held, total = lang, total + v
        if held is not None:
            yield held, total.tolist()

    known = df.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    schema = "lang string, v array<double>"
    made = map_rows(known, rows, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = map_rows(made.repartition("lang", "salt").sortWithinPartitions("lang").select("lang", "v"), add, schema)
    every = map_rows(some.repartition("lang").sortWithinPartitions("lang").select("lang", "v"), add, schema)
    return Profiles({r["lang"]: np.array(r["v"]) for r in every.collect()})


def predict(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every text: doc_id, lang_pred, score (cosine, 0 to 1).

    Narrow: one pass, no shuffle. Null texts, texts without a letter, and any text where there are
    no profiles give ``und`` and 0; null ids and repeated rows pass through; an empty table gives no
    rows; other columns are ignored. Ties go to the name that sorts first.
    """
    held = df.sparkSession.sparkContext.broadcast(profiles)

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        classify = held.value.classify
        for doc_id, text in feed:
            yield (doc_id, *classify(text))

    return map_rows(texts(df, id_col, text_col), rows, "doc_id long, lang_pred string, score double")


def keep_identified(df: DataFrame, profiles: Profiles, least: float = 0.1, least_letters: int = 200, text_col: str = "text") -> DataFrame:
    """Rows of ``df``, all columns, that have a language: texts without a letter go, and texts of at
    least ``least_letters`` characters whose cosine with every prototype is below ``least``;
    shorter texts say too little to be rejected."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("boolean")
    def stays(text):
        release()
        classify = held.value.classify

        def one(t: str | None) -> bool:
            lang, cosine = classify(t)
            return lang != "und" and (cosine >= least or len(t) < least_letters)

        return text.map(one).astype(bool)

    return df.filter(stays(F.col(f"`{text_col}`")))


FOLDS, FOLD = 4, 2


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = train(docs.filter(~F.coalesce(held_out("doc_id", FOLDS, FOLD), F.lit(False))))
    found = predict(docs, profiles)
    return found.select("doc_id", F.coalesce(held_out("doc_id", FOLDS, FOLD), F.lit(False)).alias("held_out"), "lang_pred", "score")
