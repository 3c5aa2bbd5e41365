"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two documents link when the Jaccard similarity of their sets of word n-grams reaches the threshold, so each must share a
share of its set with the other. Sets are known by 64-bit hashes of their n-grams, equal sets by a hash of the set.

1. Each set's least hashes (a prefix that linked sets must share a number of) go by hash; a set that shares too few with
   any other has no links. What recurs is settled where the rows are read, so a hot n-gram sends some rows a task.
2. Of the sets left, each n-gram has an inverted list, and a set's lists are ordered by length, to a factor of four. If a
   set of n must share T n-grams, what links with it stands in one of all but its T - 1 last lists: its short lists.
3. In rounds, some members of each short list are its heads, 16 times as many in each round, until all have been. The
   heads' sets are indexed in buckets of some hundred. The list's members of other components are searched in the buckets
   with heads of it: a query merges its short lists there, and looks up what occurs often enough in its long lists by
   binary search. Links join components, and a list whose members are all in one is done. So a group of near copies meets
   some heads, not all of itself, and only sets that stay apart meet each other; no row stands for a pair that doesn't link.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.bitmaps import bitmap, inside
from lattica.llm.graph import Union, components
from lattica.llm.skew import split_join
from lattica.llm.staging import drop, stage
from lattica.llm.textops import LOWER, WINDOW, mix, pieces, raw, spans, tidy, windows, word_hashes


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams, one after the other, and where each text's begin.

    A text of fewer words, but not none, has its whole sequence as one.
    """
    data, off = raw(texts)
    data = LOWER[data]
    starts, ends, ptr = spans(data, off)
    words = word_hashes(data, starts, ends)
    first = windows(ptr, n)
    grams = WINDOW(words, first, first + n) if len(first) else np.zeros(0, np.uint64)
    cut = np.searchsorted(first, ptr)
    sizes = np.diff(ptr)
    few = np.flatnonzero((sizes > 0) & (sizes < n))
    whole = dict(zip(few.tolist(), WINDOW(words, ptr[few], ptr[few + 1]), strict=True)) if len(few) else {}
    sets = [np.unique(grams[cut[d] : cut[d + 1]]) if sizes[d] >= n else np.array([whole[d]], np.uint64) if d in whole else np.zeros(0, np.uint64) for d in range(len(sizes))]
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), begin


def set_names(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hash of each set as a signed number; 0 for the empty set."""
    size = np.diff(begin)
    named = WINDOW(values, begin[:-1], begin[1:]) ^ mix(size.astype(np.uint64))
    return np.where(size > 0, named.view(np.int64), 0)


class Need:
    """Overlaps that a similarity of at least percent/100 asks of sets of n."""

    def __init__(self, percent: int):
        self.percent = percent

    def share(self, n):
        return -(-self.percent * n // 100)

    def common(self, n):
        """How many prefix elements two linked sets share at least, if the larger has n."""
        return np.maximum(1, n // 8)

    def prefix(self, n):
        return n - self.share(n) + self.common(n)

    def linked(self, overlap, n, m):
        return 100 * overlap >= self.percent * (n + m - overlap)


class _Met:
    """What a task has met: a table of bounded size. state 1: once, sent; 2: again by another set, sent. What it forgets is
    sent again."""

    def __init__(self, bits: int = 20):
        self.mask = np.uint64((1 << bits) - 1)
        self.value, self.by = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)
        self.state = np.zeros(1 << bits, np.int8)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (mix(values) & self.mask).astype(np.int64)
        return slot, (self.state[slot] > 0) & (self.value[slot] == values)

    def put(self, slot: np.ndarray, values: np.ndarray, by: np.ndarray, state: np.ndarray) -> None:
        free = (self.state[slot] < 2) | (values & np.uint64(15) == 0)
        at = slot[free]
        self.value[at], self.by[at], self.state[at] = values[free], by[free], state[free]


def _first_pass(text: str, n: int, need: Need):
    def run(batches):
        sets, seen = _Met(18), _Met()
        for batch in pieces(batches, text):
            values, begin = shingle_sets(batch.column(text), n)
            names, size = set_names(values, begin), np.diff(begin)
            _, one = np.unique(names, return_index=True)
            one = one[size[one] > 0]
            slot, old = sets.find(names[one].view(np.uint64))  # equal sets have sent their n-grams already
            sets.put(slot[~old], names[one[~old]].view(np.uint64), names[one[~old]], np.ones(int((~old).sum()), np.int8))
            one = one[~old]
            take = np.minimum(need.prefix(size[one]), size[one])
            index = np.repeat(begin[one] - np.concatenate([[0], np.cumsum(take)])[:-1], take) + np.arange(take.sum())
            hashes, owner = values[index], np.repeat(one, take)
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            length = np.diff(np.concatenate([first, [len(hashes)]]))
            rank = np.arange(len(hashes)) - np.repeat(first, length)
            slot, met = seen.find(hashes[first])
            met &= seen.by[slot] != names[owner[first]]
            told = met & (seen.state[slot] == 2)  # two sets have sent it from here: that is enough for all tasks
            seen.state[slot[met]] = 2
            seen.put(slot[~met], hashes[first[~met]], names[owner[first[~met]]], np.where(length[~met] > 1, 2, 1).astype(np.int8))
            shared = np.repeat((length > 1) | met, length)
            local = np.bincount(owner[shared], minlength=len(names))
            sent = np.flatnonzero((rank < 2) & ~np.repeat(told, length))
            sent = sent[np.argsort(owner[sent], kind="stable")]  # a set's rows together: its name packs well
            m = len(sent)
            d = batch.num_rows
            cols = ["id", "name", "size", "local", "gram", "open"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names), pa.array(size.astype(np.int32)), pa.array(local.astype(np.int32)), pa.nulls(d, pa.int64()), pa.nulls(d, pa.int32())], names=cols)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, batch.column("id").type), pa.array(names[owner[sent]]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.array(hashes[sent].view(np.int64)), pa.array((~shared[sent]).astype(np.int32))], names=cols
            )

    return run


def _second_pass(text: str, n: int, words):
    def run(batches):
        wanted = words.value
        sets = _Met(18)
        for batch in batches:
            batch = batch.filter(pa.array(inside(wanted, batch.column("hash").to_numpy(zero_copy_only=False))))
            for piece in pieces([batch] if batch.num_rows else [], text):
                values, begin = shingle_sets(piece.column(text), n)
                names, one = np.unique(set_names(values, begin), return_index=True)
                one, names = one[names != 0], names[names != 0]
                slot, old = sets.find(names.view(np.uint64))
                sets.put(slot[~old], names[~old].view(np.uint64), names[~old], np.ones(int((~old).sum()), np.int8))
                one, names = one[~old], names[~old]
                grams = [values[begin[i] : begin[i + 1]].view(np.int64) for i in one]
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(grams, pa.list_(pa.int64()))], names=["name", "grams"])

    return run


class Index:
    """Inverted lists of some sets of hashes, and T-occurrence search over them."""

    def __init__(self, sets: list[np.ndarray], need: Need):
        self.need, self.size = need, [len(s) for s in sets]
        owner = np.repeat(np.arange(len(sets)), self.size)
        self.grams, code = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True)
        self.n = max(1, len(sets))
        self.keys = np.sort(code * self.n + owner)  # the lists one after the other, each in order of its members
        self.begin = np.searchsorted(self.keys, np.arange(len(self.grams) + 1) * self.n)

    def search(self, query: np.ndarray) -> list[tuple[int, int]]:
        """(set, overlap) of the sets that link with the query: DivideSkip.

        T is the least overlap. Of the query's lists the L longest are long, L = T / (log2(longest) + 1) as merging costs
        more the longer the lists. The others are merged, by a heap if they are few: what links occurs T - L times there.
        Those are looked up in the long lists by binary search.
        """
        n = len(query)
        if not len(self.grams):
            return []
        at = np.minimum(np.searchsorted(self.grams, query), len(self.grams) - 1)
        codes = at[self.grams[at] == query]
        least = int(self.need.share(n))
        if not len(codes) or len(codes) < least:
            return []
        length = self.begin[codes + 1] - self.begin[codes]
        order = np.argsort(length, kind="stable")
        codes, length = codes[order], length[order]
        skip = min(least - 1, int(least / (np.log2(length[-1]) + 1)))
        short, long = codes[: len(codes) - skip], codes[len(codes) - skip :]
        total = int(length[: len(codes) - skip].sum())
        if total <= 64:
            merged = heapq.merge(*[(self.keys[self.begin[c] : self.begin[c + 1]] % self.n).tolist() for c in short.tolist()])
            counts = [(one, sum(1 for _ in times)) for one, times in groupby(merged)]
        else:
            first = np.repeat(self.begin[short] - np.concatenate([[0], np.cumsum(length[: len(short)])])[:-1], length[: len(short)])
            times = np.bincount(self.keys[first + np.arange(total)] % self.n, minlength=self.n)
            often = np.flatnonzero(times >= least - skip)
            counts = list(zip(often.tolist(), times[often].tolist(), strict=True))
        out = []
        for one, overlap in counts:
            m = self.size[one]
            if overlap < least - skip or 100 * m < self.need.percent * n or 100 * n < self.need.percent * m:
                continue
            if skip:
                wanted = long * self.n + one
                found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                overlap += int((self.keys[found] == wanted).sum())
            if self.need.linked(overlap, n, m):
                out.append((one, overlap))
        return out


def _search(need: Need):
    """Rows by (bucket, part, kind): the heads of a bucket (kind 0), then its queries. Gives links (a, b), of those in one
    part enough to join all that link there."""

    def run(batches):
        here, heads, sets, index, index_of, joined = None, [], [], None, {}, None
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                a, b = [], []
                places = zip(batch.column("bucket").to_pylist(), batch.column("part").to_pylist(), strict=True)
                kinds, names, grams = batch.column("kind").to_pylist(), batch.column("name").to_pylist(), batch.column("grams")
                for row, place in enumerate(places):
                    if place != here:
                        here, heads, sets, index = place, [], [], None
                    own = grams[row].values.to_numpy()
                    if kinds[row] == 0:
                        heads.append(names[row])
                        sets.append(own)
                        continue
                    if index is None:
                        index, joined = Index(sets, need), Union(len(sets))
                        index_of = {name: k for k, name in enumerate(heads)}
                    found = [k for k, _ in index.search(own)]
                    self_ = index_of.get(names[row], -1)
                    for k in found:
                        if k != self_ and (self_ < 0 and k == found[0] or joined.join(k, self_ if self_ >= 0 else found[0])):
                            a.append(names[row])
                            b.append(heads[k])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            tidy()

    return run


def _links(queries: DataFrame, heads: DataFrame, grams: DataFrame, need: Need, per_part: int = 4096) -> DataFrame:
    """(a, b) of queries (bucket, name) and the heads (bucket, name) of their bucket that link with them. A bucket's queries
    go into parts of about ``per_part``, each with the bucket's index."""
    parts = stage(queries.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / per_part).cast("int").alias("parts")))
    asked = split_join(queries, parts, ["bucket"]).select("bucket", F.pmod(F.hash("name"), F.col("parts")).alias("part"), F.lit(1).alias("kind"), "name")
    told = heads.join(parts, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "name")
    rows = told.unionByName(asked).join(grams, "name")
    n = max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = stage(rows.repartition(n, "bucket", "part").sortWithinPartitions("bucket", "part", "kind", "name").select("bucket", "part", "kind", "name", "grams").mapInArrow(_search(need), "a long, b long"))
    drop(parts)
    return out


def _parts(n):
    return F.ceil(n / 2048).cast("int")


#: Lists of more than these lengths come after all others, in this order.
TIERS = (1, 4, 16, 64, 256, 1024, 4096)


def short_lists(grams: DataFrame, percent: int) -> DataFrame:
    """(gram, n, name, size, u, part): each set's short lists with another member in theirs; n is how many have the list as
    a short one, u a number in [0, 1) of the set. A long list's members are in parts of some thousand.

    Which lists are longer than each tier is told by bitmaps of bounded size; what one tells wrongly is told alike to all.
    """
    spark = grams.sparkSession
    need = Need(percent)
    counts = stage(grams.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    sizes = counts.agg(*[F.count(F.when(F.col("n") > t, 1)) for t in TIERS]).first()
    marks = spark.sparkContext.broadcast([bitmap(counts.where(F.col("n") > t), F.col("gram"), k, (1 << 25) if t == 1 else (1 << 23)) for t, k in zip(TIERS, sizes, strict=True) if k])
    drop(counts)

    def cut(batches):
        for batch in batches:
            lists = batch.column("grams")
            flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(size)), size)
            tier = np.zeros(len(flat), np.int64)
            for words in marks.value:
                tier += inside(words, flat)
            keep = np.flatnonzero(tier > 0)
            keep = keep[np.lexsort((flat[keep], tier[keep], owner[keep]))]
            own = np.bincount(owner[keep], minlength=len(size))
            first = np.concatenate([[0], np.cumsum(own)])[:-1]
            taken = keep[np.arange(len(keep)) - first[owner[keep]] < (own - need.share(size) + 1)[owner[keep]]]
            o = owner[taken]
            yield pa.RecordBatch.from_arrays([pa.array(flat[taken]), batch.column("name").take(pa.array(o)), pa.array(size[o].astype(np.int32))], names=["gram", "name", "size"])

    short = stage(grams.mapInArrow(cut, "gram long, name long, size int"))
    marks.destroy()
    lists = stage(short.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    u = F.pmod(F.xxhash64("name", F.lit(7)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    out = stage(split_join(short, lists, ["gram"]).select("gram", "n", "name", "size", u.alias("u"), F.pmod(F.hash("name"), _parts(F.col("n"))).alias("part")))
    drop(short)
    drop(lists)
    return out


def linked_sets(grams: DataFrame, percent: int, first: int = 4, faster: int = 16, per_bucket: int = 256) -> DataFrame:
    """(name, root) of sets (name, grams): root names the component of a set's links. Sets without short lists are left out."""
    need = Need(percent)
    members = short_lists(grams, percent)
    roots = stage(members.groupBy("name").agg(F.first("name").alias("root")))
    was, most = 0, first  # heads that a list has had before the round, and by its end
    every_part = F.explode(F.sequence(F.lit(0), _parts(F.col("n")) - 1)).alias("part")
    while True:
        # Members of lists with two components at least; old heads have met all others of their lists.
        now = members.withColumn("root", F.col("name")) if was == 0 else members.drop("root").where(F.col("u") * F.col("n") >= was).join(roots, "name")
        if was:
            open_ = now.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.first("n").alias("n")).where(F.col("low") < F.col("high"))
            now = stage(now.join(open_.select("gram", every_part), ["gram", "part"]))
            drop(members)
            members = now
            if members.isEmpty():
                break
        else:
            now = members = stage(now)
        is_head = F.col("u") * F.col("n") < most
        heads = stage(members.where(is_head).select(F.col("name"), "root", "size", "u").distinct())
        n = max(1, -(-heads.count() // per_bucket))
        bucket = F.pmod(F.xxhash64("name"), F.lit(n)).alias("bucket")
        of_list = members.where(is_head).select("gram", "n", bucket, "root", "size", "u").groupBy("gram", "n", "bucket")
        of_list = of_list.agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("size").alias("least"), F.max("size").alias("largest"), F.max("u").alias("last"))
        of_list = of_list.select("gram", every_part, "bucket", "low", "high", "least", "largest", "last")
        wanted = (F.col("root") != F.col("low")) | (F.col("root") != F.col("high"))
        wanted &= (100 * F.col("largest") >= percent * F.col("size")) & (100 * F.col("size") >= percent * F.col("least"))
        wanted &= ~is_head | (F.col("u") < F.col("last"))  # of two heads, one asks
        queries = stage(members.join(of_list, ["gram", "part"]).where(wanted).select("bucket", "name").distinct())
        if not queries.isEmpty():
            links = _links(queries, heads.select(bucket, "name"), grams, need)
            of = lambda c: roots.select(F.col("name").alias(c), F.col("root").alias(f"root_{c}"))
            between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).where("a <> b").distinct()
            joined = stage(components(between).select(F.col("node").alias("root"), F.col("root").alias("least")))
            new = stage(split_join(roots, joined, ["root"], "left").select("name", F.coalesce("least", "root").alias("root")))
            for table in (links, joined, roots):
                drop(table)
            roots = new
        drop(queries)
        drop(heads)
        was, most = most, most * faster
    drop(members)
    return roots


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, name) of each document: the size of its set, the least id it reaches by links, and
    its set's hash (0 for the empty set), which with the id names a row for what follows.

    Documents with equal sets link. Null texts and texts without words have the empty set, link with nothing and are
    their own component; very long texts take part whole. Repeated rows are each returned; of equal least ids any will
    do. Exact but for collisions of 64-bit hashes. The id can be of any type that has an order; rows of null id take part,
    and a component of such rows alone has null as its id. An empty table gives an empty table; other columns, whatever
    their names, don't matter.
    """
    spark = docs.sparkSession
    need = Need(percent)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    rows = stage(slim.mapInArrow(_first_pass("text", n, need), f"id {kind}, name long, size int, local int, gram long, open int"))
    documents = stage(rows.where("size is not null").select("id", "name", "size", "local"))
    by_gram = Window.partitionBy("gram")
    shared = rows.where("gram is not null").select("gram", "name", "open").withColumn("few", F.min("name").over(by_gram) == F.max("name").over(by_gram)).where("not few and open = 1").groupBy("name").agg(F.count(F.lit(1)).alias("shared"))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("size") * percent / 100) / 8))
    sets = stage(documents.where("name <> 0").groupBy("name").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.max("local").alias("local")))
    names = stage(sets.join(shared, "name", "left").where(F.col("local") + F.coalesce("shared", F.lit(0)) >= least).select("name", "id", "size"))
    drop(rows)
    hashed = F.xxhash64("id")
    wanted = spark.sparkContext.broadcast(bitmap(names, hashed, names.count(), 1 << 26))
    grams = slim.withColumn("hash", hashed).mapInArrow(_second_pass("text", n, wanted), "name long, grams array<long>")
    grams = stage(grams.join(names.select("name"), "name", "left_semi").groupBy("name").agg(F.first("grams").alias("grams")))
    wanted.destroy()
    drop(names)
    roots = linked_sets(grams, percent)
    drop(grams)
    of_set = stage(sets.select("name", F.col("id").alias("low")).join(roots, "name", "left").select("name", "low", F.coalesce("root", "name").alias("root")))
    lowest = stage(of_set.groupBy("root").agg(F.min("low").alias("component_id")))
    of_set = stage(split_join(of_set, lowest, ["root"]).select("name", "component_id"))
    for table in (lowest, roots, sets):
        drop(table)
    linked = split_join(documents.where("name <> 0").select("id", "size", "name"), of_set, ["name"])
    out = linked.select("id", "size", "name", "component_id").unionByName(documents.where("name = 0").select("id", "size", "name", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), "component_id", "name")


__all__ = ["Index", "Need", "linked_sets", "ngram_join", "shingle_sets"]
