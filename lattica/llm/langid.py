"""Language identification with hyperdimensional profiles.

Each letter has a random vector of signs. A trigram is the letters' vectors, rotated by their place and multiplied; a text
is the sum over its trigrams; a language is the sum over its texts. Documents go to the language of the largest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.textops import pieces

UNKNOWN = "und"


class Letters:
    """Letter vectors by code point, and the bundles of a batch of texts."""

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed = dims, seed
        self.vectors: dict[int, np.ndarray] = {}
        self.alpha = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.place = np.zeros(0x110000, np.int64)

    def vector(self, code: int) -> np.ndarray:
        if code not in self.vectors:
            self.vectors[code] = np.random.default_rng([self.seed, code]).choice(np.array([-1, 1], np.float32), self.dims)
        return self.vectors[code]

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the trigram vectors of each text, and whether it has a letter.

        Trigrams are taken some thousand at a time, so memory is bounded by the texts' bytes: where few of the texts hold a
        trigram by adding up rows, else by a matrix product. All sums are of whole numbers, so both give the same.
        """
        low = [f" {t.lower()} " if t else "  " for t in texts]
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(low)
        row = np.repeat(np.arange(n), [len(t) for t in low])
        letter = self.alpha[codes]
        has = np.bincount(row[letter], minlength=n) > 0
        codes = np.where(letter, codes, 32)
        keep = np.ones(len(codes), bool)
        keep[1:] = letter[1:] | letter[:-1] | (row[1:] != row[:-1])
        codes, row = codes[keep], row[keep]
        used = np.flatnonzero(np.bincount(codes))
        self.place[used] = np.arange(len(used))
        at, k = self.place[codes], len(used)
        inside = row[2:] == row[:-2]
        grams = ((at[:-2] * k + at[1:-1]) * k + at[2:])[inside]
        # Counts of (trigram, text), by trigram: 21 bits a letter would be too many, so trigrams are numbered first.
        found, column = np.unique(grams, return_inverse=True)
        pair, count = np.unique(column * n + row[:-2][inside], return_counts=True)
        column, row, count = pair // max(n, 1), pair % max(n, 1), count.astype(np.float32)
        base = np.stack([self.vector(int(c)) for c in used]) if k else np.zeros((0, self.dims), np.float32)
        two, one = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
        out = np.zeros((n, self.dims), np.float32)
        step = max(64, min(8192, (1 << 22) // max(n, 1)))
        for first in range(0, len(found), step):
            some = found[first : first + step]
            vectors = two[some // (k * k)] * one[some // k % k] * base[some % k]
            low_at, high_at = np.searchsorted(column, [first, first + step])
            c, r, v = column[low_at:high_at] - first, row[low_at:high_at], count[low_at:high_at]
            if len(c) * 16 >= n * len(some):
                matrix = np.zeros((n, len(some)), np.float32)
                matrix[r, c] = v
                out += matrix @ vectors
                continue
            order = np.argsort(r, kind="stable")
            for at_ in range(0, len(order), 8192):
                part = order[at_ : at_ + 8192]
                new = np.flatnonzero(np.concatenate([[True], np.diff(r[part]) != 0]))
                out[r[part][new]] += np.add.reduceat(vectors[c[part]] * v[part][:, None], new, axis=0)
        return out, has


def learn(docs: DataFrame, text_col: str, lang_col: str, dims: int, seed: int, most: int = 1000) -> dict[str, np.ndarray]:
    """Unit profile of each language in docs, summed over all of them.

    The driver gets dims numbers for each language, and ``most`` languages at most: it raises beyond.
    """

    def run(batches):
        letters = Letters(dims, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches, "text"):
            langs = batch.column("lang").to_pylist()
            totals, _ = letters.bundles(batch.column("text").to_pylist())
            for name in set(langs):
                own = totals[[i for i, lang in enumerate(langs) if lang == name]].sum(axis=0, dtype=np.float64)
                sums[name] = sums.get(name, 0) + own
            while len(sums) > 2000:  # a label that is no language's name mustn't fill the task
                name, total = sums.popitem()
                yield rows(name, total)
        for name, total in sums.items():
            yield rows(name, total)

    def rows(name, total):
        return pa.RecordBatch.from_arrays([pa.array([name] * dims), pa.array(range(dims), pa.int32()), pa.array(total)], names=["lang", "dim", "value"])

    slim = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    out: dict[str, np.ndarray] = {}
    found = slim.mapInArrow(run, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value")).limit(most * dims + 1).collect()
    if len(found) > most * dims:
        raise ValueError(f"more than {most} languages among the labels")
    for lang, dim, value in found:
        out.setdefault(lang, np.zeros(dims))[dim] = value
    return {name: v / (np.linalg.norm(v) or 1.0) for name, v in sorted(out.items())}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", dims: int = 512, seed: int = 5) -> DataFrame:
    """(row, lang_pred, score): row holds the columns of docs as they were.

    score is the cosine with the nearest profile, 0 where it is negative; equal cosines go to the first language by code
    point. Null text, text without a letter and an empty set of profiles give ``und`` with score 0. Texts are read
    whole, however long; each row is judged alone by its text, so repeated rows agree and other columns don't matter,
    whatever their names; an empty table gives an empty table.
    """
    names, matrix = list(profiles), np.array(list(profiles.values()), np.float32).reshape(len(profiles), dims)
    at = docs.columns.index(text_col)

    def run(batches):
        letters = Letters(dims, seed)
        for whole in batches:
            texts = pa.RecordBatch.from_arrays([whole.column("row"), pc.struct_field(whole.column("row"), [at])], names=["row", "text"])
            for batch in pieces([texts], "text"):
                bundles, has = letters.bundles(batch.column("text").to_pylist())
                norms = np.linalg.norm(bundles, axis=1)
                known = has & (norms > 0) & bool(names)
                pred, score = [UNKNOWN] * len(has), np.zeros(len(has))
                if names:
                    cosines = bundles @ matrix.T / np.where(norms > 0, norms, 1)[:, None]
                    best = cosines.argmax(axis=1)
                    pred = [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                    score = np.where(known, np.clip(cosines.max(axis=1), 0, 1), 0.0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(pred, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = slim.schema["row"].dataType
    return slim.mapInArrow(run, T.StructType([T.StructField("row", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col: str, of: int = 4, remainder: int = 2):
    """Whether the document is kept from the learner; a null id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % of == remainder, F.lit(False))


def detect_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dims: int = 512, seed: int = 5) -> DataFrame:
    """(row, lang_pred, score), learned from the documents that held_out() doesn't name."""
    profiles = learn(docs.where(~held_out(id_col)), text_col, lang_col, dims, seed)
    return identify(docs, profiles, text_col, dims, seed)
