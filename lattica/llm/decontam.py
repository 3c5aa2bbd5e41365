"""Benchmark decontamination with a generalised suffix automaton of the normalised test items."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.staging import Shared, drop, stage
from lattica.llm.textops import pieces

#: A-Z to a-z; all other ASCII but letters and digits to a space; bytes of other characters stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The same words in Spark: A-Z are lower-cased, then these are words.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class SuffixAutomaton:
    """All word sequences within the items, none across two of them; streams a document's words.

    ``window`` consecutive item words are a window; an item of fewer words is one window as a whole.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.names = window, [name for name, _ in items]
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in items]
        for text in texts:
            last = 0
            for w in text:
                last = self._extend(last, w)
        own: list[set[int]] = [set() for _ in self.next]
        whole: dict[int, list[tuple[int, int]]] = {}
        for k, text in enumerate(texts):
            state = 0
            for i, w in enumerate(text):
                state = self.next[state][w]
                if i + 1 >= window:
                    own[state].add(k)
            if 0 < len(text) < window:
                whole.setdefault(state, []).append((len(text), k))
        for s in sorted(range(1, len(own)), key=lambda s: -self.length[s]):
            if self.length[self.link[s]] >= window:
                own[self.link[s]] |= own[s]
        self.own = own
        # The state of each state's last ``window`` words: where the climb along suffix links would end.
        self.top = list(range(len(own)))
        for s in sorted(range(1, len(own)), key=lambda s: self.length[s]):
            if self.length[self.link[s]] >= window:
                self.top[s] = self.top[self.link[s]]
        self.short: list[tuple[tuple[int, int], ...]] | None = None
        if whole:
            self.short = [()] * len(own)
            for s in sorted(range(1, len(own)), key=lambda s: self.length[s]):
                self.short[s] = self.short[self.link[s]] + tuple(whole.get(s, ()))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Spans of words inside an occurrence of a window, and the items with occurring windows."""
        nxt, link, length, own, short, window, top = self.next, self.link, self.length, self.own, self.short, self.window, self.top
        spans: list[list[int]] = []
        items: set[int] = set()
        state = matched = 0
        for i, w in enumerate(map(self.ids.get, words)):
            if w is None:
                state = matched = 0
                continue
            to = nxt[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = nxt[state].get(w)
                matched = length[state]
                if to is None:
                    state = matched = 0
                    continue
            state = to
            matched += 1
            if matched >= window:
                items |= own[top[state]]
                self._cover(spans, i + 1 - matched, i + 1)
            if short is not None and short[state]:
                for n, k in short[state]:
                    if n <= matched:
                        items.add(k)
                        self._cover(spans, i + 1 - n, i + 1)
        return spans, items

    @staticmethod
    def _cover(spans: list[list[int]], start: int, end: int) -> None:
        while spans and spans[-1][1] >= start:
            start = min(start, spans.pop()[0])
        spans.append([start, end])


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items with words, those of null id too, in blocks of about ``most`` words; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = normal_words((row["t"] or "").encode())
        if words:
            block.append((row["i"], words))
            size += len(words)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


SPANS = "array<struct<start:long,end:long>>"


def _merge(spans: list[list[int]]) -> list[dict]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [{"start": s, "end": e} for s, e in out]


def _items(names: set) -> list:
    return sorted(names - {None}) + [None] * (None in names)


def _scan(spark, automaton: SuffixAutomaton, only_hits: bool):
    """Arrow function: the batch's other columns with n_words, spans and items; rows without a hit go if only_hits."""
    shared = Shared(spark, automaton)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        auto = shared.get()
        for batch in pieces(batches, "text"):
            n, spans, items = [], [], []
            for text in batch.column("text"):
                words = normal_words(text.as_py())
                hit, found = auto.scan(words)
                n.append(len(words))
                spans.append(_merge(hit))
                items.append(_items({auto.names[k] for k in found}))
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "text"], pa.array(n, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], names=[*[c for c in batch.schema.names if c != "text"], "n_words", "spans", "items"])
            yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if only_hits else out

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = 200_000) -> DataFrame:
    """Where windows of the items occur in the documents.

    Returns (row, leak): row holds the columns of docs as they were, leak is (n_words, spans, items): the words of the
    document, the spans of words inside occurrences (touching ones merged) and the items that have occurring windows,
    sorted as strings; one null at the end stands for all items of null id. The automaton of one block of items
    (``block_words``, about 100 MB) goes to the executors at a time. One block is one pass over the documents; of more
    blocks each is a pass that writes the documents with hits alone (their text's 96-bit hash and the spans), and the hits
    are joined at the end. Null and empty texts have no words, very long ones are read whole, in linear time; items
    without words are none; equal items each count; repeated rows are each reported; an empty table of either kind gives
    no spans; the columns of docs may have any names.
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    every = iter(blocks(benchmark, item_id, item_text, block_words))
    block, second = next(every, []), next(every, None)
    if second is None:
        slim = docs.select(row, F.col(text_col).cast("binary").alias("text"))
        schema = T.StructType().add("row", slim.schema["row"].dataType).add("n_words", "long").add("spans", T.DataType.fromDDL(SPANS)).add("items", T.ArrayType(T.StringType()))
        found = slim.mapInArrow(_scan(spark, SuffixAutomaton(block, window), False), schema)
        return found.select("row", F.struct("n_words", "spans", "items").alias("leak"))
    key = (F.xxhash64(F.col(text_col)).alias("one"), F.hash(F.col(text_col)).alias("two"))
    texts = docs.where(F.col(text_col).isNotNull()).select(*key, F.col(text_col).cast("binary").alias("text"))
    parts = []
    for part in chain([block, second], every):
        parts.append(stage(texts.mapInArrow(_scan(spark, SuffixAutomaton(part, window), True), f"one long, two int, n_words long, spans {SPANS}, items array<string>")))
    hits = reduce(DataFrame.unionByName, parts).groupBy("one", "two").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    merged = F.aggregate(
        F.array_sort("spans"),
        F.array().cast(SPANS),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))),
    )
    hits = stage(hits.select("one", "two", merged.alias("spans"), F.array_sort(F.array_distinct("items")).alias("items")))
    for part in parts:
        drop(part)
    n_words = F.regexp_count(F.translate(F.col(text_col), UPPER, UPPER.lower()), F.lit(WORDS)).cast("long")
    slim = docs.select(row, *key, F.coalesce(n_words, F.lit(0)).alias("n_words"))
    none = (F.array().cast(SPANS), F.array().cast("array<string>"))
    return slim.join(hits, ["one", "two"], "left").select("row", F.struct("n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items")).alias("leak"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_coverage: float = 0.0, block_words: int = 200_000) -> DataFrame:
    """The documents without those that leak: columns of docs as they were.

    A document goes if the words inside occurrences of windows (whole items of fewer words included) are more than
    ``max_coverage`` of its words; with 0.0 each is too much. Below the limit the spans are cut from the text. Documents
    without words stay.
    """
    leaks = find_leaks(docs, benchmark, text_col, item_id, item_text, window, block_words)
    hit = F.aggregate("leak.spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    kept = leaks.where(hit <= F.lit(max_coverage) * F.col("leak.n_words"))
    if max_coverage <= 0:
        return kept.select("row.*")
    return kept.select(*[(_cut(F.col(f"row.`{c}`"), F.col("leak.spans")) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _cut_spans(texts, spans):
    import pandas as pd

    out = []
    for text, found in zip(texts, spans, strict=True):
        if text is not None and len(found):
            data = text.encode()
            normal = np.frombuffer(data.translate(NORMAL), np.uint8) != 32
            edge = np.diff(np.concatenate([[0], normal.view(np.int8), [0]]))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            left, at = [], 0
            for s in sorted(found, key=lambda s: s["start"]):
                left.append(data[at : starts[s["start"]]])
                at = int(ends[s["end"] - 1])
            text = b"".join([*left, data[at:]]).decode()
        out.append(text)
    return pd.Series(out)


def _cut(text, spans):
    return F.pandas_udf(_cut_spans, "string")(text, spans)
