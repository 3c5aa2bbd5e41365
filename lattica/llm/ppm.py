"""Language-model scores by prediction by partial matching over byte contexts, and by smoothed word counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.staging import Shared, stage
from lattica.llm.textops import LOWER, pieces, raw, spans, word_hashes

#: Stands before and after each text; no byte of UTF-8 has this value.
EDGE = 0xFF
ORDER = 3
#: The word "end of text" among word hashes.
END = np.int64(-0x61C8864680B583EB)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each byte with the three before it, the end of the text included, and where each text's codes begin."""
    n = len(off) - 1
    sizes = np.diff(off)
    at = np.arange(len(data)) + ORDER + np.repeat(np.arange(n) * (ORDER + 1), sizes)
    padded = np.full(len(data) + n * (ORDER + 1), EDGE, np.uint32)
    padded[at] = data
    codes = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    first = off[:-1] + np.arange(n) * (ORDER + 1)
    ptr = np.concatenate([[0], np.cumsum(sizes + 1)])
    index = np.repeat(first - ptr[:-1], sizes + 1) + np.arange(ptr[-1])
    return codes[index], ptr


class Trie:
    """Byte contexts of up to three bytes with the counts of the byte that follows, as sorted arrays.

    The code length of a byte: in the longest known context with total t and q different followers, a follower counted n
    times has n / (t + q), and escape q / (t + q). After an escape, the shorter context is asked without the symbols that
    were excluded. Below the empty context all symbols that are left are alike.

    If ``lower`` is given, keys are whole contexts but not all of them, and lower has the codes of three bytes of the whole
    corpus (16.8 million at most): what follows a longest context that isn't here has to be looked up elsewhere.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, lower: tuple[np.ndarray, np.ndarray] | None = None):
        order = np.argsort(keys)
        keys, counts = keys[order].astype(np.uint32), counts[order].astype(np.int64)
        self.whole = lower is None
        self.levels = [(keys, counts)]  # (context << 8 | symbol, count), from the longest context to the empty one
        below, n = (keys, counts) if lower is None else (lower[0].astype(np.uint32), lower[1])
        for depth in range(ORDER - 1, -1, -1):
            found, at = np.unique(below & np.uint32((1 << (8 * (depth + 1))) - 1), return_inverse=True)
            self.levels.append((found, np.bincount(at, n, len(found)).astype(np.int64) if len(found) else np.zeros(0, np.int64)))
        context = keys >> np.uint32(8)
        _, at = np.unique(context, return_inverse=True)
        total, q = np.bincount(at, counts), np.bincount(at)
        self.logs = np.log10(counts / (total[at] + q[at])) if len(keys) else np.zeros(0)
        bits = max(10, min(22, int(len(keys) * 6).bit_length()))
        self.shift = np.uint32(32 - bits)
        self.slot_key = np.zeros(1 << bits, np.uint32)
        self.slot_log = np.full(1 << bits, np.nan, np.float64)
        slots = (keys * np.uint32(0x9E3779B1)) >> self.shift
        self.slot_key[slots] = keys
        kept = self.slot_key[slots] == keys
        self.slot_log[slots[kept]] = self.logs[kept]
        self.keys = keys
        self.contexts = np.unique(context)
        self.memo: dict[int, float] = {}

    def followers(self, level: int, code: int) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = self.levels[level]
        depth = ORDER - level
        context = (code >> 8) & ((1 << (8 * depth)) - 1)
        low, high = np.searchsorted(keys, [context << 8, (context << 8) + 256])
        return keys[low:high] & np.uint32(0xFF), counts[low:high]

    def log(self, code: int, longest: tuple[np.ndarray, np.ndarray] | None = None) -> float:
        """Log10 probability of the code's last byte after the ones before it; longest has what follows all of them."""
        symbol, out, gone = code & 0xFF, 0.0, np.zeros(256, bool)
        for level in range(ORDER + 1):
            symbols, counts = longest if longest is not None and level == 0 else self.followers(level, code)
            left = ~gone[symbols]
            symbols, counts = symbols[left], counts[left]
            if len(symbols) == 0:
                continue
            t, q = int(counts.sum()), len(symbols)
            hit = np.flatnonzero(symbols == symbol)
            if len(hit):
                return out + np.log10(counts[hit[0]] / (t + q))
            out += np.log10(q / (t + q))
            gone[symbols] = True
        return out - np.log10(256 - int(gone.sum()))

    def known(self, codes: np.ndarray) -> np.ndarray:
        """Whether score() has each code: the trie is whole, or holds the code's context."""
        if self.whole or not len(self.contexts):
            return np.full(len(codes), self.whole)
        context = codes >> np.uint32(8)
        return self.contexts[np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)] == context

    def score(self, codes: np.ndarray) -> np.ndarray:
        slots = (codes * np.uint32(0x9E3779B1)) >> self.shift
        out = np.where(self.slot_key[slots] == codes, self.slot_log[slots], np.nan)
        rest = np.flatnonzero(np.isnan(out))
        if len(rest):
            found, back = np.unique(codes[rest], return_inverse=True)
            at = np.searchsorted(self.keys, found)
            logs = np.empty(len(found))
            for i, (code, j) in enumerate(zip(found.tolist(), at.tolist(), strict=True)):
                if j < len(self.keys) and self.keys[j] == code:
                    logs[i] = self.logs[j]
                else:
                    if code not in self.memo:
                        if len(self.memo) > 200_000:
                            self.memo.clear()
                        self.memo[code] = self.log(code)
                    logs[i] = self.memo[code]
            out[rest] = logs[back]
        return out


def _squeeze(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([c for _, c in parts])[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _tally(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.concatenate([first, [len(values)]]))


def corpus_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, key, n): counts over all texts of byte codes (kind 0) and of word hashes, end of text included (kind 1)."""

    def run(batches):
        def out(kind, parts):
            keys, counts = _squeeze(parts)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["kind", "key", "n"])

        bytes_, words, waiting, ends = [], [], 0, 0
        for batch in pieces(batches, "text"):
            data, off = raw(batch.column("text"))
            codes, _ = grams(data, off)
            bytes_.append(_tally(codes))
            data = LOWER[data]
            starts, stops, _ = spans(data, off)
            words.append(_tally(word_hashes(data, starts, stops).view(np.int64)))
            ends += len(off) - 1
            bytes_ = [_squeeze(bytes_)]
            waiting += len(words[-1][0])
            if waiting > 2_000_000:
                yield out(1, words)
                words, waiting = [], 0
        if bytes_:
            yield out(0, bytes_)
            yield out(1, [*words, (np.array([END]), np.array([ends]))])

    made = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind int, key long, n long")
    return made.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _model(counts: DataFrame, most_codes: int) -> Trie:
    """The whole trie, or with more than ``most_codes`` codes its most frequent contexts and all shorter ones."""
    codes = counts.where("kind = 0").select("key", "n")
    if codes.count() <= most_codes:
        every = codes.toPandas()
        return Trie(every["key"].to_numpy(), every["n"].to_numpy())
    short = codes.groupBy((F.col("key") % (1 << 24)).alias("key")).agg(F.sum("n").alias("n")).toPandas()
    context = F.shiftright("key", 8)
    often = codes.groupBy(context.alias("context")).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "context").limit(max(1, most_codes // 64))
    top = codes.withColumn("context", context).join(F.broadcast(often), "context", "left_semi").toPandas()
    return Trie(top["key"].to_numpy(), top["n"].to_numpy(), (short["key"].to_numpy(), short["n"].to_numpy()))


def _rare(counts: DataFrame, wanted: DataFrame, trie: Shared) -> DataFrame:
    """(code, log) of codes whose contexts the trie lacks: each is joined with what follows its context in the corpus."""
    codes = counts.where("kind = 0").select(F.shiftright("key", 8).alias("context"), F.struct((F.col("key") % 256).cast("int").alias("s"), "n").alias("f"))
    need = wanted.select("code", F.shiftright("code", 8).alias("context"))
    follow = codes.join(need.select("context").distinct(), "context", "left_semi").groupBy("context").agg(F.collect_list("f").alias("f"))

    def run(batches):
        model = trie.get()
        for batch in batches:
            logs = []
            for code, f in zip(batch.column("code").to_pylist(), batch.column("f").to_pylist(), strict=True):
                f = sorted((x["s"], x["n"]) for x in f or ())
                logs.append(float(model.log(code, (np.array([s for s, _ in f], np.int64), np.array([n for _, n in f], np.int64)))))
            yield pa.RecordBatch.from_arrays([batch.column("code"), pa.array(logs, pa.float64())], names=["code", "log"])

    return need.join(follow, "context", "left").select("code", "f").mapInArrow(run, "code long, log double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_fold: int = 0, top_words: int = 1 << 17, most_codes: int = 4 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document.

    Both models learn from all documents whose crc32(id as text) modulo ``folds`` isn't ``held_fold`` (a null id is
    learned from). The byte model is a trie of four-byte codes. Up to ``most_codes`` of them (natural text has some
    hundred thousand) it goes to the executors as a whole; beyond, its most frequent contexts and all shorter ones go, and
    codes after other contexts are joined with the counts. Word counts stay in a table: the ``top_words`` most frequent go
    to the executors, and all others are joined. Null text is empty: it has the end token alone. Very long texts are
    scored whole. Repeated rows each teach and are each scored; equally frequent words and contexts go to the executors by
    their key; other columns, whatever their names, don't matter. Without training documents V and N are 0 and the byte
    model is uniform; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held_fold, F.lit(False))
    counts = stage(corpus_counts(docs.where(~held), text_col))
    words = counts.where("kind = 1")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    trie = Shared(spark, _model(counts, most_codes))
    top = words.orderBy(F.desc("n"), "key").limit(top_words).select("key", "n").toPandas().sort_values("key")
    vocabulary = spark.sparkContext.broadcast((top["key"].to_numpy(), top["n"].to_numpy()))
    below = total + 0.1 * (distinct + 1)
    names = ["row", "id", "held", "n_tokens", "n_known", "base", "score", "word", "code", "c"]

    def run(batches):
        model = trie.get()
        keys, seen = vocabulary.value
        logs = np.log10((seen + 0.1) / below)
        next_row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "text"):
            n = batch.num_rows
            rows = np.arange(next_row, next_row + n)
            next_row += n
            data, off = raw(batch.column("text"))
            code, ptr = grams(data, off)
            here = model.known(code)
            logs_of = np.zeros(len(code))
            logs_of[here] = model.score(code[here])
            sums = np.concatenate([[0.0], np.cumsum(logs_of)])
            data = LOWER[data]
            starts, stops, first = spans(data, off)
            hashes = word_hashes(data, starts, stops).view(np.int64)
            doc = np.repeat(np.arange(n), np.diff(first))
            hashes, doc = np.concatenate([hashes, np.full(n, END)]), np.concatenate([doc, np.arange(n)])
            at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
            known = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
            base = np.bincount(doc[known], logs[at[known]], n)
            n_known = np.bincount(doc[known], minlength=n)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("id"), batch.column("held"), pa.array(np.diff(first) + 1), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(sums[ptr[1:]] - sums[ptr[:-1]]), none, none, none], names=names)

            def others(doc, value, at):
                """Rows of what isn't known here, with the times that it occurs in its document."""
                m = len(value)
                order = np.lexsort((value, doc))
                doc, value = doc[order], value[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(value) != 0)]))
                times = np.diff(np.concatenate([new, [m]]))
                m = len(new)
                empty = [pa.nulls(m, t) for t in (batch.column("id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                two = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())]
                two[at] = pa.array(value[new].astype(np.int64))
                return pa.RecordBatch.from_arrays([pa.array(rows[doc[new]]), *empty, *two, pa.array(times.astype(np.int64))], names=names)

            if not known.all():
                yield others(doc[~known], hashes[~known], 0)
            if not here.all():
                yield others(np.repeat(np.arange(n), np.diff(ptr))[~here], code[~here].astype(np.int64), 1)

    slim = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    scored = stage(slim.mapInArrow(run, f"row long, id {kind}, held boolean, n_tokens long, n_known long, base double, score double, word long, code long, c long"))
    seen = words.select(F.col("key").alias("word"), "n")
    log = F.log10((F.coalesce(F.col("n"), F.lit(0)) + 0.1) / F.lit(float(below)))
    rest = scored.where("word is not null").select("row", "word", "c").join(seen, "word", "left").select("row", (F.col("c") * log).alias("rest_base"), F.when(F.col("n").isNotNull(), F.col("c")).otherwise(0).alias("rest_known"), F.lit(0.0).alias("rest_score"))
    far = scored.where("code is not null").select("row", "code", "c")
    if not far.isEmpty():
        rare = stage(_rare(counts, far.select("code").distinct(), trie))
        rest = rest.unionByName(far.join(rare, "code").select("row", F.lit(0.0).alias("rest_base"), F.lit(0).cast("long").alias("rest_known"), (F.col("c") * F.col("log")).alias("rest_score")))
    rest = rest.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("rest_base", "rest_known", "rest_score")])
    out = scored.where("n_tokens is not null").select("row", "id", "held", "n_tokens", "n_known", "base", "score").join(rest, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("rest_score", zero)).alias("score")
    )


__all__ = ["Trie", "corpus_counts", "grams", "score_documents"]
