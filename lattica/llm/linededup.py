"""Line dedup with a segment-partition edit join.

Lines within ``threshold`` edits of each other link. If the shorter is cut into threshold + 1 segments, one of them stands
unchanged in the longer, at a place that the lengths and the segment's number bound. So lines send the hashes of their
segments, and probes for the substrings that may match segments of lines as long or somewhat shorter; lines that meet are
verified with the banded bit-parallel edit distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.bitmaps import bitmap, inside
from lattica.llm.graph import Union, components
from lattica.llm.skew import split_join
from lattica.llm.staging import drop, stage
from lattica.llm.textops import BYTES, mix, pieces, raw, tidy



class Lines:
    """Lines of a batch of texts: code points, where each begins and ends without white space around, and names."""

    def __init__(self, texts: pa.Array):
        data, off = raw(texts)
        whole = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = whole[off]
        self.codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        new = np.flatnonzero(self.codes == 10)
        start = np.sort(np.concatenate([at[:-1], new + 1]))
        end = np.sort(np.concatenate([at[1:], new]))
        n = np.searchsorted(new, at[1:]) - np.searchsorted(new, at[:-1]) + 1
        self.doc = np.repeat(np.arange(len(at) - 1), n)
        self.number = np.arange(len(start)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
        solid = np.flatnonzero((self.codes != 32) & ((self.codes < 9) | (self.codes > 13)))
        if len(solid):
            first, last = np.searchsorted(solid, start), np.searchsorted(solid, end) - 1
            some = first <= last
            self.start = np.where(some, solid[np.minimum(first, len(solid) - 1)], start)
            self.end = np.where(some, solid[last] + 1, self.start)
        else:
            self.start = self.end = start
        self.size = self.end - self.start
        self.sums = BYTES.sums(self.codes.astype(np.uint64) + np.uint64(1))
        self.name = (BYTES.of(self.sums, self.start, self.end) ^ mix(self.size.astype(np.uint64))).view(np.int64)

    def text(self, i: int) -> str:
        return self.codes[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "replace")


def segment(size: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Offset and length of segment i of lines of a size: as even as can be, the longer ones last."""
    base, more = size // parts, size % parts
    longer = np.maximum(0, i - (parts - more))
    return base * i + longer, base + (i >= parts - more)


def keys_of(lines: Lines, which: np.ndarray, threshold: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, whether it is a probe) of the segments and probes of the lines in ``which``."""
    parts = threshold + 1
    size, start = lines.size[which], lines.start[which]
    keys, owner, probe = [], [], []

    def add(ok, offset, length, short, i, is_probe):
        begin = start[ok] + offset[ok]
        tag = mix((short[ok] * parts + i).astype(np.uint64))
        keys.append((BYTES.of(lines.sums, begin, begin + length[ok]) ^ tag).view(np.int64))
        owner.append(which[ok])
        probe.append(np.full(len(begin), is_probe, np.int32))

    every = np.ones(len(which), bool)
    for i in range(parts):
        offset, length = segment(size, i, parts)
        add(every, offset, length, size, i, 0)
        for less in range(threshold + 1):
            short = size - less
            offset, length = segment(short, i, parts)
            for shift in range(max(-i, less - (threshold - i)), min(i, less + threshold - i) + 1):
                ok = (short >= least) & (offset + shift >= 0) & (offset + shift + length <= size)
                add(ok, offset + shift, length, short, i, 1)
    return np.concatenate(keys), np.concatenate(owner), np.concatenate(probe)


def within(a: list[np.ndarray], b: list[np.ndarray], k: int) -> np.ndarray:
    """Whether the edit distance of each pair of code-point arrays is k at most: Hyyro's banded bit-parallel algorithm.

    A column's vertical differences in the band are two words of bits; the highest bit is the band's lower edge. All pairs
    take a step together, and pairs that can't come back under k leave.
    """
    out = np.zeros(len(a), bool)
    one, two = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    order = np.argsort(two, kind="stable")
    # Pairs of like length together, at most 4096 and about a million code points a side.
    cut, first = [], 0
    for i in range(len(order)):
        if i - first >= 4096 or (i > first and (i - first + 1) * int(two[order[i]]) > 1 << 20):
            cut.append(i)
            first = i
    for part in np.split(order, cut) if len(order) else []:
        part = part[np.abs(one[part] - two[part]) <= k]
        if not len(part):
            continue
        n, m = one[part], two[part]
        rows = int(n.max()) + 2 * k + 2
        left = np.full((len(part), rows), 0xFFFFFFFF, np.uint32)
        right = np.full((len(part), int(m.max())), 0xFFFFFFFE, np.uint32)
        for r, p in enumerate(part):
            left[r, k : k + n[r]] = a[p]
            right[r, : m[r]] = b[p]
        top, U = np.uint64(63), np.uint64
        vp = np.full(len(part), (1 << 64) - (1 << (63 - k)), U)
        vn = np.zeros(len(part), U)
        cost = np.full(len(part), k, np.int64)
        level = np.full(len(part), 62, np.int64)
        alive = np.arange(len(part))
        for i in range(int(m.max())):
            x = np.zeros(len(alive), U)
            char = right[alive, i]
            for bit in range(2 * k + 1):  # row i + k - bit of the pattern, padded by k in front
                at = i + 2 * k - bit
                if at < rows:
                    x |= (left[alive, at] == char).astype(U) << U(63 - bit)
            d0 = (((x & vp) + vp) ^ vp) | x | vn
            hp = vn | ~(d0 | vp)
            hn = d0 & vp
            slope = i < n[alive] - k
            step = np.where(slope, 1 - (d0 >> top).astype(np.int64), ((hp >> level.astype(U)) & U(1)).astype(np.int64) - ((hn >> level.astype(U)) & U(1)).astype(np.int64))
            running = i < m[alive]
            cost[alive] += np.where(running, step, 0)
            level = np.where(slope | ~running, level, level - 1)
            shifted = d0 >> U(1)
            vp = np.where(running, hn | ~(shifted | hp), vp)
            vn = np.where(running, shifted & hp, vn)
            if i % 8 == 7:
                stay = cost[alive] <= 2 * k + np.abs(m[alive] - n[alive]) + k
                if not stay.all():
                    alive, vp, vn, level = alive[stay], vp[stay], vn[stay], level[stay]
                    if not len(alive):
                        break
        ok = np.zeros(len(part), bool)
        ok[alive] = cost[alive] <= k
        out[part] = ok
    return out


class Group:
    """Links between a group's index rows (at most some hundred, given first) and its probes, which come in batches:
    enough of them to join all that link."""

    def __init__(self, k: int):
        self.k, self.names, self.codes = k, [], []
        self.place: dict[int, int] = {}
        self.up: Union | None = None

    def add(self, name: int, codes: np.ndarray) -> None:
        if name not in self.place:
            self.place[name] = len(self.names)
            self.names.append(name)
            self.codes.append(codes)

    def links(self, probes: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
        """A probe meets one line of each component of the index first, and the component's others if that doesn't link."""
        if self.up is None:
            self.up = Union(len(self.names))
        out: list[tuple[int, int]] = []
        for at in range(0, len(probes), 64):
            some = probes[at : at + 64]
            members: dict[int, list[int]] = {}
            for i in range(len(self.names)):
                members.setdefault(self.up.find(i), []).append(i)
            own = {j: self.up.find(self.place[name]) if name in self.place else -1 for j, (name, _) in enumerate(some)}
            todo = [(j, r) for j in range(len(some)) for r in members if own[j] != r]
            joined: dict[int, list[int]] = {j: [r] if r >= 0 else [] for j, r in own.items()}
            for rest in (False, True):
                pairs = [(j, r, i) for j, r in todo for i in (members[r][1:] if rest else members[r][:1])]
                linked = set()
                for first in range(0, len(pairs), 50_000):
                    part = pairs[first : first + 50_000]
                    ok = within([self.codes[i] for _, _, i in part], [some[j][1] for j, _, _ in part], self.k)
                    linked |= {(j, r, i) for (j, r, i), y in zip(part, ok.tolist(), strict=True) if y}
                seen = set()
                for j, r, i in sorted(linked):
                    if (j, r) not in seen:
                        seen.add((j, r))
                        joined[j].append(r)
                        out.append((self.names[i], some[j][0]))
                todo = [x for x in todo if x not in seen]
            for roots in joined.values():
                for r in roots[1:]:
                    self.up.join(roots[0], r)
        return out


def _verify(k: int):
    """Rows (key, part, probe, name, line) in this order; gives links (a, b)."""

    def run(batches):
        here, group, waiting = None, Group(k), []
        one, two = [], []  # pairs of small groups, verified together
        out: list[tuple[int, int]] = []
        seen: set[tuple[int, int]] = set()

        def settle():
            ok = within([c for _, c in one], [c for _, c in two], k)
            out.extend((a, b) for (a, _), (b, _), y in zip(one, two, ok.tolist(), strict=True) if y)
            one.clear()
            two.clear()
            seen.clear()

        def ask():
            if len(group.names) > 40:
                out.extend(group.links(waiting))
            else:
                for name, codes in waiting:
                    for other, its in zip(group.names, group.codes, strict=True):
                        pair = (min(name, other), max(name, other))
                        if name != other and pair not in seen:
                            seen.add(pair)
                            one.append((other, its))
                            two.append((name, codes))
            waiting.clear()

        def rows():
            found = pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])
            out.clear()
            return found

        for batch in batches:
            places = zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), strict=True)
            for place, probe, name, line in zip(places, batch.column("probe").to_pylist(), batch.column("name").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if place != here:
                    ask()
                    here, group = place, Group(k)
                codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
                if probe == 0:
                    group.add(name, codes)
                else:
                    waiting.append((name, codes))
                    if len(waiting) >= 1024:
                        ask()
                if len(one) >= 20_000:
                    settle()
            settle()
            yield rows()
            tidy()
        ask()
        settle()
        yield rows()
        tidy()

    return run


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, least: int = 30, shortest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(places, classes): places (id, hash, number, name) of all lines of ``shortest`` code points, classes (name, root).

    Lines equal but for white space around have one name; classes holds the names that link with another, of lines of
    ``least`` code points. Without ``shortest`` both begin at ``least``.
    """
    shortest = least if shortest is None else max(1, min(shortest, least))
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    longs = pa.list_(pa.int64())

    def cut(batches):
        """Rows of two kinds: places of lines, and for each line of the piece the keys of its segments and its probes."""
        cols = ["id", "hash", "number", "name", "segments", "probes"]
        for batch in pieces(batches, "text"):
            lines = Lines(batch.column("text"))
            some = np.flatnonzero(lines.size >= shortest)
            if not len(some):
                continue
            d = pa.array(lines.doc[some])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(d), batch.column("hash").take(d), pa.array(lines.number[some].astype(np.int32)), pa.array(lines.name[some]), pa.nulls(len(some), longs), pa.nulls(len(some), longs)], names=cols)
            long = some[lines.size[some] >= least]
            if not len(long):
                continue
            _, one = np.unique(lines.name[long], return_index=True)
            one = long[np.sort(one)]
            key, owner, probe = keys_of(lines, one, threshold, least)
            lists = []
            for kind in (0, 1):
                mine = np.flatnonzero(probe == kind)
                mine = mine[np.argsort(owner[mine], kind="stable")]
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[mine], np.append(one, len(lines.name))).astype(np.int32)), pa.array(key[mine])))
            n = len(one)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, batch.column("id").type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(lines.name[one]), *lists], names=cols)

    rows = stage(slim.mapInArrow(cut, f"id {kind}, hash long, number int, name long, segments array<long>, probes array<long>"))
    places = stage(rows.where("segments is null").select("id", "hash", "number", "name"))
    keyed = rows.where("segments is not null").select("name", "segments", "probes")
    # Keys of two lines at least, by partial sums; the few rows that have them; and of those the keys with both kinds of rows.
    shared = stage(keyed.select("name", F.explode(F.concat("segments", "probes")).alias("key")).groupBy("key").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low < high").select("key"))
    marks = spark.sparkContext.broadcast(bitmap(shared, F.col("key"), shared.count()))
    drop(shared)

    def some(batches):
        for batch in batches:
            for probe, column in enumerate(("segments", "probes")):
                of = batch.column(column)
                flat = of.flatten().to_numpy()
                here = np.flatnonzero(inside(marks.value, flat))
                line = np.repeat(np.arange(len(of)), of.value_lengths().to_numpy())[here]
                yield pa.RecordBatch.from_arrays([pa.array(flat[here]), batch.column("name").take(pa.array(line)), pa.array(np.full(len(here), probe, np.int32))], names=["key", "name", "probe"])

    near = stage(keyed.mapInArrow(some, "key long, name long, probe int").distinct())
    marks.destroy()
    drop(rows)
    keys = stage(near.groupBy("key").agg(F.min("name").alias("low"), F.max("name").alias("high"), F.sum("probe").alias("probes"), F.count(F.lit(1)).alias("n")).where("low < high and probes > 0 and probes < n").select("key", F.ceil((F.col("n") - F.col("probes")) / 512).cast("int").alias("high"), F.ceil(F.col("probes") / 512).cast("int").alias("wide")))
    met = stage(split_join(near, keys, ["key"]))
    for table in (near, keys):
        drop(table)
    names = stage(met.select("name").distinct())
    wanted = spark.sparkContext.broadcast(bitmap(names, F.col("name"), names.count()))

    def texts(batches):
        marks = wanted.value
        for batch in pieces(batches, "text"):
            lines = Lines(batch.column("text"))
            _, one = np.unique(lines.name, return_index=True)
            one = one[(lines.size[one] >= least) & inside(marks, lines.name[one])]
            yield pa.RecordBatch.from_arrays([pa.array(lines.name[one]), pa.array([lines.text(i) for i in one.tolist()], pa.string())], names=["name", "line"])

    line = stage(slim.select("text").mapInArrow(texts, "name long, line string").join(names, "name", "left_semi").groupBy("name").agg(F.min("line").alias("line")))
    wanted.destroy()
    # A key's index rows and its probes go into parts of about 512 each, and each part of the one meets each of the other.
    row, column = F.pmod(F.hash("name"), F.col("high")), F.pmod(F.hash("name"), F.col("wide"))
    across = F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda c: row * F.col("wide") + c)
    down = F.transform(F.sequence(F.lit(0), F.col("high") - 1), lambda r: r * F.col("wide") + column)
    spread = met.withColumn("part", F.explode(F.when(F.col("probe") == 0, across).otherwise(down)))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    grouped = spread.join(line, "name").select("key", "part", "probe", "name", "line").repartition(n, "key", "part").sortWithinPartitions("key", "part", "probe")
    links = stage(grouped.mapInArrow(_verify(threshold), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for table in (met, names, line):
        drop(table)
    return places, components(links).withColumnRenamed("node", "name")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, least: int = 30, shortest: int | None = None) -> DataFrame:
    """(row, n_lines, removed, first_ids, kept_text): row holds the columns of docs as they were.

    Of the lines that are equal or link, directly or by others, the one of the least id, then the least number, stays;
    removed lists the numbers of the others, first_ids the documents of the lines that stand for them. Lines of fewer
    than ``least`` code points (white space around not counted) link with none by edits; equal ones of ``shortest`` code
    points (``least`` if not given) are one line all the same, and those shorter still stay, as do lines of white space
    alone. kept_text has the lines that stay; of ties nothing depends on the order of rows.
    Null text stays null and has no lines; empty text is one line. Rows of equal id and text count as one document and
    fare alike. An empty table gives an empty table; very long lines and
    texts take part whole; other columns of docs, whatever their names, don't matter.
    """
    places, classes = line_classes(docs, id_col, text_col, threshold, least, shortest)
    of = stage(split_join(places, classes, ["name"], "left").select("id", "hash", "number", F.coalesce("root", "name").alias("class")))
    here = F.struct("id", "number", "hash")
    first = stage(of.groupBy("class").agg(F.min(here).alias("first"), F.max(here).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).select("class", "first"))
    gone = split_join(of, first, ["class"]).where(~here.eqNullSafe(F.col("first"))).groupBy(F.col("id").alias("_id"), F.col("hash").alias("_hash")).agg(F.array_sort(F.collect_set(F.struct("number", F.col("first.id").alias("first")))).alias("gone"))
    gone = stage(gone)
    for table in (places, classes, of, first):
        drop(table)
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"), F.col(text_col).alias("text"))
    joined = slim.join(gone, slim["id"].eqNullSafe(gone["_id"]) & (slim["hash"] == gone["_hash"]), "left").select("row", "text", "gone")
    numbers = F.transform("gone", lambda g: g["number"])
    lines = F.split("text", "\n")
    # Time in proportion to the lines, however many go: array_except hashes, and split runs once.
    stay = lambda some: F.array_except(F.sequence(F.lit(0), F.size(some) - 1), numbers)
    kept = F.transform(F.array(lines), lambda some: F.array_join(F.transform(stay(some), lambda i: some[i]), "\n"))[0]
    return joined.select(
        "row",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(numbers, F.array().cast("array<int>")).alias("removed"),
        F.coalesce(F.array_distinct(F.transform("gone", lambda g: g["first"])), F.array().cast(f"array<{docs.schema[id_col].dataType.simpleString()}>")).alias("first_ids"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
