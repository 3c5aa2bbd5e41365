"""Substring dedup: windows of words that start anywhere else, as paths of a De Bruijn graph of word k-mers.

1. Windows of ``window`` words are counted. A sparse set of short k-mers (the least hash of each window, its minimizer)
   names candidates first: a window whose minimizer has no second place can't recur. The candidates are counted by 96-bit
   hashes. Repeated windows at consecutive places of a document are a run.
2. The runs' words make a sparse De Bruijn graph: nodes are the k-mers whose hash falls in one of ``every`` classes, and
   the ends of runs; an edge is the words from one such k-mer of a run to the next. Where a few words repeat in a row, only
   the first time round has nodes. A run is split at rarer nodes first, so that near copies share most of its pieces; each
   distinct piece is cut into edges once, however many documents have it. Degrees are counted over the distinct edges.
   Where a node has one edge in and one out, the two belong to one path: pointer doubling by joins gives each edge its
   path and its offset there.
3. A path's edges that stand at matching offsets and touch are one span, first of a distinct piece, then in the
   coordinates of each document with that piece. Spans are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.bitmaps import bitmap, inside
from lattica.llm.skew import MOST_HOT, split_join
from lattica.llm.staging import drop, stage
from lattica.llm.textops import WINDOW, WINDOW2, pieces, raw, spans, windows, word_hashes

#: A k-mer that comes again within so many words of a run doesn't split it again: words that repeat in a row would give a node
#: each time round.
NEAR = 256


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) of each ``width`` neighbours."""
    out, reach = x, 1
    while reach * 2 <= width:
        out = f(out[:-reach], out[reach:])
        reach *= 2
    return out if reach == width else f(out[: len(out) - (width - reach)], out[width - reach :])


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = raw(texts)
    starts, ends, ptr = spans(data, off)
    return word_hashes(data, starts, ends), ptr


def anchors(words: np.ndarray, ptr: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each anchor, first word of each window, minimizer of each window)."""
    first = windows(ptr, window)
    if not len(first):
        return np.zeros(0, np.uint64), first, np.zeros(0, np.uint64)
    n = len(words) - k + 1
    grams = WINDOW(words, np.arange(n), np.arange(n) + k)
    width = window - k + 1
    low = _slide(grams, width, np.minimum)
    mine = low[first]
    # An anchor is each k-mer that is the least of some window of its document, with all its places.
    valid = np.zeros(len(low), np.uint64)
    valid[first] = mine
    most = _slide(np.concatenate([np.zeros(width - 1, np.uint64), valid, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    return grams[(most == grams) & (most > 0)], first, mine


class Seen:
    """Windows or runs that a task has met before: a table of bounded size, so that a passage in every piece of the input sends
    some rows for each task, not for each piece. What it forgets is counted like anything new."""

    def __init__(self, bits: int = 20):
        self.mask = np.uint64((1 << bits) - 1)
        self.one, self.two = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint32)
        self.state = np.zeros(1 << bits, np.int8)  # 1: sent as a window of one place; 2: told to recur

    def meet(self, one: np.ndarray, two: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(met before, to be told to recur) of distinct windows; many says which recur in this piece."""
        slot = (one & self.mask).astype(np.int64)
        met = (self.state[slot] > 0) & (self.one[slot] == one) & (self.two[slot] == two)
        tell = np.where(met, self.state[slot] == 1, many)
        self.state[slot[met]] = 2
        free = ~met & ((self.state[slot] < 2) | (two & np.uint32(15) == 0))
        at = slot[free]
        self.one[at], self.two[at], self.state[at] = one[free], two[free], np.where(many[free], 2, 1)
        return met, tell


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, key2, id, text): 96 bits of id and text name a row; rows equal in both share them and fare alike."""
    both = (F.col(id_col), F.col(text_col))
    return docs.select(F.xxhash64(*both).alias("key"), F.hash(*both).alias("key2"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def repeated_windows(docs: DataFrame, window: int = 35, k: int = 8) -> DataFrame:
    """(key, key2, runs) of the keyed documents that have any: runs is an array of (start, n), n windows in a row that
    start anywhere else, from word start on.

    Windows that recur within a piece or, as far as Seen remembers, a task are settled there.
    """
    spark = docs.sparkSession

    def find(batches):
        for batch in pieces(batches, "text"):
            hashes, _, _ = anchors(*_words(batch.column("text")), window, k)
            found, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int32))], names=["anchor", "n"])

    twice = stage(docs.select("text").mapInArrow(find, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    wanted = spark.sparkContext.broadcast(bitmap(twice, F.col("anchor"), twice.count()))
    drop(twice)

    def edges(batches):
        """Rows of kind 1: a window with one place in its piece; 2: one that recurs; 3: a run of windows settled here."""
        marks, seen = wanted.value, Seen()
        cols = ["one", "two", "kind", "key", "key2", "start", "n"]

        def rows(batch, ptr, kind, at, n, one, two):
            doc = np.searchsorted(ptr, at, side="right") - 1
            d = pa.array(doc)
            return pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int32)), pa.array(kind.astype(np.int8)), batch.column("key").take(d), batch.column("key2").take(d), pa.array((at - ptr[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], names=cols)

        for batch in pieces(batches, "text"):
            words, ptr = _words(batch.column("text"))
            _, first, least = anchors(words, ptr, window, k)
            at = first[inside(marks, least.view(np.int64))] if len(first) else first
            if not len(at):
                continue
            one, two = WINDOW(words, at, at + window), (WINDOW2(words, at, at + window) >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((two, one))
            new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
            begin = np.flatnonzero(new)
            length = np.diff(np.concatenate([begin, [len(at)]]))
            heads = order[begin]
            many = length > 1
            met, tell = seen.meet(one[heads], two[heads], many)
            settled = np.empty(len(at), bool)
            settled[order] = np.repeat(many | met, length)
            here = at[settled]
            if len(here):
                doc = np.searchsorted(ptr, here, side="right") - 1
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(here) != 1) | (np.diff(doc) != 0)]))
                n = np.diff(np.concatenate([cut, [len(here)]]))
                yield rows(batch, ptr, np.full(len(cut), 3), here[cut], n, one[settled][cut] + np.arange(len(cut), dtype=np.uint64), two[settled][cut])
            kind = np.zeros(len(at), np.int8)
            kind[heads] = np.where(tell, 2, np.where(many | met, 0, 1))
            sent = kind > 0  # in the order of the text, so documents' names pack well
            yield rows(batch, ptr, kind[sent], at[sent], np.ones(int(sent.sum())), one[sent], two[sent])

    found = docs.select("key", "key2", "text").mapInArrow(edges, "one long, two int, kind byte, key long, key2 int, start int, n int")
    # A window recurs if it has two rows. The settled runs go along, each alone.
    same = Window.partitionBy("one", "two", F.col("kind") == 3)
    found = found.withColumn("rows", F.count(F.lit(1)).over(same)).where("kind = 3 or kind = 1 and rows > 1")
    return found.groupBy("key", "key2").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("runs"))


def _between(first: np.ndarray, last: np.ndarray, at: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, from, to): each range first to last, split at the places in at that are inside, unless the k-mer there (grams
    has its hash) stood at a place in at of the same range less than NEAR words before."""
    low, high = np.searchsorted(at, first), np.searchsorted(at, last)
    which = np.repeat(np.arange(len(first)), high - low)
    inner = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)])[:-1], high - low) + np.arange(len(which))
    place, gram = at[inner], grams[inner]
    order = np.lexsort((place, gram, which))
    again = np.flatnonzero((np.diff(which[order]) == 0) & (np.diff(gram[order]) == 0) & (np.diff(place[order]) < NEAR))
    keep = place > first[which]
    keep[order[again + 1]] = False
    which = np.concatenate([np.arange(len(first)), which[keep], np.arange(len(first))])
    place = np.concatenate([first, place[keep], last])
    order = np.lexsort((place, which))
    which, place = which[order], place[order]
    begin = np.flatnonzero(which[1:] == which[:-1])
    return which[begin], place[begin], place[begin + 1]


def run_edges(docs: DataFrame, runs: DataFrame, window: int, k: int, every: int) -> DataFrame:
    """(key, key2, run, run2, start, n, a, b, edge): where pieces of runs stand, and the edges of distinct pieces.

    A piece ends where its run does or at a node in one of 16 * every classes; run and run2 are 96 bits of its words. A place
    of a piece has key, key2 and its first word, start, and no edge. An edge has start, from the piece's first word on, and n
    in words, its nodes a and b and the hash of its words, and no key; a piece's edges come once, or once for each task that
    meets it and for each time that Seen forgets it. Nodes that stood less than NEAR words before in the same run (for
    pieces) or piece (for edges) are passed over.
    """
    spark = docs.sparkSession
    marks = spark.sparkContext.broadcast(bitmap(runs, F.col("key"), runs.count(), 1 << 26))

    def some(batches):
        for batch in batches:
            yield batch.filter(pa.array(inside(marks.value, batch.column("key").to_numpy())))

    joined = docs.select("key", "key2", "text").mapInArrow(some, "key long, key2 int, text string").dropDuplicates(["key", "key2"]).join(runs, ["key", "key2"])

    cols = ["key", "key2", "run", "run2", "start", "n", "a", "b", "edge"]

    def cut(batches):
        seen = Seen()
        for batch in pieces(batches, "text"):
            words, ptr = _words(batch.column("text"))
            nodes = WINDOW(words, np.arange(len(words) - k + 1), np.arange(len(words) - k + 1) + k) if len(words) >= k else np.zeros(0, np.uint64)
            stations = np.flatnonzero(nodes % np.uint64(every) == 0)
            rare = stations[nodes[stations] % np.uint64(16 * every) == 0]
            of = batch.column("runs")
            doc = np.repeat(np.arange(batch.num_rows), of.value_lengths().to_numpy())
            start = of.flatten().field("start").to_numpy() + ptr[doc]
            end = start + of.flatten().field("n").to_numpy()
            # Runs that go on in one another are one: ends of windows, in words, by document.
            order = np.lexsort((start, doc))
            doc, start, end = doc[order], start[order], end[order]
            if not len(doc):
                continue
            reach = np.maximum.accumulate(end)  # places grow from document to document
            new = np.flatnonzero(np.concatenate([[True], (start[1:] > reach[:-1]) | (doc[1:] != doc[:-1])]))
            first, last = start[new], np.concatenate([reach[new[1:] - 1], reach[-1:]]) - 1 + window - k
            of, first, last = _between(first, last, rare, nodes[rare])
            doc = doc[new][of]
            one, two = WINDOW(words, first, last + k), (WINDOW2(words, first, last + k) >> np.uint64(32)).astype(np.uint32)
            run, run2 = pa.array(one.view(np.int64)), pa.array(two.view(np.int32))
            d = pa.array(doc)
            none = pa.nulls(len(doc), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(d), batch.column("key2").take(d), run, run2, pa.array((first - ptr[doc]).astype(np.int32)), none.cast(pa.int32()), none, none, none], names=cols)
            order = np.lexsort((two, one))
            new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
            heads = order[new]
            met, _ = seen.meet(one[heads], two[heads], np.zeros(len(heads), bool))
            heads = np.sort(heads[~met])
            if not len(heads):
                continue
            # Nodes of each piece: its first and last k-mer and the stations between.
            of, p, q = _between(first[heads], last[heads], stations, nodes[stations])
            r = pa.array(heads[of])
            none = pa.nulls(len(p), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none.cast(pa.int32()), run.take(r), run2.take(r), pa.array((p - first[heads[of]]).astype(np.int32)), pa.array((q - p).astype(np.int32)), pa.array(nodes[p].view(np.int64)), pa.array(nodes[q].view(np.int64)), pa.array(WINDOW2(words, p, q + k).view(np.int64))],
                names=cols,
            )

    return joined.mapInArrow(cut, "key long, key2 int, run long, run2 int, start int, n int, a long, b long, edge long")


def compact(edges: DataFrame) -> DataFrame:
    """(edge, path, offset) of distinct edges (edge, a, b, n): the nonbranching path that an edge is on, named by its first
    edge, and how many words into it. Edges on a cycle without a branch are paths of their own."""
    ins = edges.groupBy(F.col("b").alias("v")).agg(F.min("edge").alias("into"), F.min("n").alias("n"), F.count(F.lit(1)).alias("ins"))
    outs = edges.groupBy(F.col("a").alias("v")).agg(F.min("edge").alias("edge"), F.count(F.lit(1)).alias("outs"))
    before = ins.where("ins = 1").join(outs.where("outs = 1"), "v").where("into <> edge").select("edge", F.col("into").alias("to"), "n")
    # to: the edge reached so far, going back; done: it is the first of its path.
    at = stage(edges.select("edge").join(before, "edge", "left").select("edge", F.coalesce("to", "edge").alias("to"), F.coalesce("n", F.lit(0)).cast("long").alias("offset"), F.col("to").isNull().alias("done")))
    left = at.where("not done").count()
    while left:
        far = at.select(F.col("edge").alias("to"), F.col("to").alias("next"), F.col("offset").alias("more"), F.col("done").alias("ends"))
        moved = at.where("not done").join(far, "to").select("edge", F.col("next").alias("to"), (F.col("offset") + F.col("more")).alias("offset"), F.col("ends").alias("done"))
        new = stage(at.where("done").unionByName(moved))
        drop(at)
        at, was, left = new, left, new.where("not done").count()
        if left == was:  # each round resolves the edges twice as far from the first as before: these are cycles
            break
    alone = ~F.col("done")
    return at.select("edge", F.when(alone, F.col("edge")).otherwise(F.col("to")).alias("path"), F.when(alone, F.lit(0)).otherwise(F.col("offset")).cast("long").alias("offset"))


def touching(parts: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Parts (path, base, start, end) in order, joined where one goes on in the next."""
    out: list[list[int]] = []
    for path, base, start, end in sorted(parts):
        if out and out[-1][0] == path and out[-1][1] == base and start <= out[-1][3]:
            out[-1][3] = max(out[-1][3], end)
        else:
            out.append([path, base, start, end])
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, k: int = 8, every: int = 16) -> DataFrame:
    """(key, key2, runs) of the documents with repeated windows; runs is an array of (start, parts), parts one of (path,
    base, start, end).

    Words start to end of a piece of a run are on the path, whose first word would stand at base, all from the piece's first
    word on, which is the document's word start. keyed() gives key and key2 of a row.
    """
    named = keyed(docs, id_col, text_col)
    runs = stage(repeated_windows(named, window, k))
    cuts = stage(run_edges(named, runs, window, k, every))
    drop(runs)
    edges = stage(cuts.where("edge is not null").select("run", "run2", "start", "n", "a", "b", "edge").dropDuplicates(["run", "run2", "start", "n"]))
    distinct = stage(edges.groupBy("edge").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.min("n").alias("n")))
    paths = stage(compact(distinct))
    drop(distinct)
    found = split_join(edges, paths, ["edge"]).select("run", "run2", F.struct("path", (F.col("start") - F.col("offset")).alias("base"), F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n") + k).cast("long").alias("end")).alias("e"))
    part = pa.list_(pa.struct([(c, pa.int64()) for c in ("path", "base", "start", "end")]))

    def joined(batches):
        for batch in batches:
            own = [[dict(zip(("path", "base", "start", "end"), p, strict=True)) for p in touching([tuple(e.values()) for e in of])] for of in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("run"), batch.column("run2"), pa.array(own, part)], names=["run", "run2", "parts"])

    of_run = stage(found.groupBy("run", "run2").agg(F.collect_list("e").alias("parts")).mapInArrow(joined, "run long, run2 int, parts array<struct<path:long,base:long,start:long,end:long>>"))
    drop(edges)
    drop(paths)
    # A piece of many parts has a long row, so no more pieces are broadcast than can be hot.
    placed = split_join(cuts.where("edge is null").select("key", "key2", "run", "run2", "start"), of_run, ["run", "run2"], few=MOST_HOT)
    out = stage(placed.groupBy("key", "key2").agg(F.collect_list(F.struct("start", "parts")).alias("runs")))
    drop(cuts)
    drop(of_run)
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, k: int = 8, with_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans, paths[, kept_text]) of each document.

    Each word covered by a window of ``window`` words that starts anywhere else, in the same document too, is removed;
    windows are judged on the input. kept_text joins the words that are left by one space, spans are the removed ones
    (start, end in words), paths the passages with places there (path, start, end). Null texts have no words; texts of
    fewer words than a window keep all; very long texts take part whole; overlapping and repeated windows of one text
    count as starts of their own; of repeated rows each has a start in the others, so all lose what a window covers; an
    empty table gives an empty table; other columns, whatever their names, don't matter. Exact but for collisions of 96-bit
    hashes of windows (made of 64-bit hashes of words) and of rows.
    """
    found = repeated_passages(docs, id_col, text_col, window, k)
    named = keyed(docs, id_col, text_col)
    joined = named.join(found, ["key", "key2"], "left").select("id", "text", "runs")
    kind = named.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    of_path = pa.list_(pa.struct([("path", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in pieces(batches, "text"):
            n_words, removed, digests, found, places, kept = [], [], [], [], [], []
            for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                own = touching([(p["path"], *(r["start"] + p[c] for c in ("base", "start", "end"))) for r in runs or () for p in r["parts"]])
                gone: list[list[int]] = []
                for s, e in sorted((s, e) for _, _, s, e in own):
                    if gone and gone[-1][1] >= s:
                        gone[-1][1] = max(gone[-1][1], e)
                    else:
                        gone.append([s, e])
                left, at = [], 0
                for s, e in gone:
                    left += words[at:s]
                    at = e
                left += words[at:]
                joined = b" ".join(left)
                n_words.append(len(words))
                removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(joined).hexdigest())
                found.append([{"start": s, "end": e} for s, e in gone])
                places.append([{"path": p, "start": s, "end": e} for p, _, s, e in own])
                kept.append(joined.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(found, span), pa.array(places, of_path), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256", "spans", "paths", "kept_text"]
            )

    out = joined.mapInArrow(cut, f"id {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, paths array<struct<path:long,start:long,end:long>>, kept_text string").withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept_text")
