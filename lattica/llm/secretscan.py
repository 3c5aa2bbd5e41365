"""Secret scans: three patterns, and a battery of randomness tests with length-aware false-discovery control."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.staging import stage
from lattica.llm.textops import pieces

#: Fixed patterns. A match of the first is dropped unless group 2 has 6 characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: What could be a key of some encoding.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Encodings by alphabet, smallest first.
ALPHABETS = (("hex", "0123456789abcdef"), ("hex", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_HINTS = ("pass", "secret", "token", "api")


def encoding_of(s: str) -> tuple[str, str]:
    for name, alphabet in ALPHABETS:
        if all(c in alphabet for c in s):
            return name, alphabet
    return "base64", ALPHABETS[-1][1] + ("-_" if "-" in s or "_" in s else "+/")


def upper(z: float) -> float:
    """P(Z >= z) of a standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def battery(s: str) -> tuple[float, float]:
    """(p if random, p if ordinary text) of a candidate.

    Chi-squared distance from the uniform alphabet, runs of character classes, and lag-one serial correlation of symbol
    values. Under randomness each is tested against its own distribution, and the least of the three counts, times
    three. Under ordinary text (letters of uneven frequency, few changes of class, neighbours of like value) the three
    p-values are combined by Fisher's method: small if the string is too even for text.
    """
    s = s.rstrip("=")
    n = len(s)
    _, alphabet = encoding_of(s)
    k = len(alphabet)
    counts = Counter(s)
    chi = sum(v * v for v in counts.values()) * k / n - n
    flat = upper((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    classes = [_class(c) for c in s]
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    shares = [sum(_class(c) == x for c in alphabet) / k for x in range(4)]
    rate = 1 - sum(x * x for x in shares)
    runs = math.erfc(abs(changes - (n - 1) * rate) / math.sqrt(2 * (n - 1) * rate * (1 - rate)))
    at = [alphabet.index(c) for c in s]
    mean = sum(at) / n
    spread = sum((x - mean) ** 2 for x in at)
    r = sum((x - mean) * (y - mean) for x, y in zip(at, at[1:], strict=False)) / spread if spread else 1.0
    serial = math.erfc(abs(r) * math.sqrt(n / 2))
    # Ordinary text: the sum of squared letter frequencies is about 0.066.
    uneven = max(k * 0.066 - 1, 0.35)
    text_flat = upper((n * uneven + k - 1 - chi) / math.sqrt(2 * (k - 1) + 4 * n * uneven))
    between = sum(c in "-_/+" for c in s)  # a separator of words changes the class twice, a capital after it once more
    text_runs = upper((changes - 3 * between - 0.5 - (n - 1) * 0.12) / math.sqrt((n - 1) * 0.12 * 0.88))
    text_serial = upper((0.4 - r) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (text_flat, text_runs, text_serial))
    return min(1.0, 3 * min(flat, runs, serial)), math.exp(-half) * (1 + half + half * half / 2)


#: p-values are rounded up to powers of 10 in steps of 1/STEPS, down to 10**-LEAST.
STEPS, LEAST = 50, 30


def length_class(n: int) -> int:
    """0 for up to 31 characters, 1 for up to 63, 2 beyond: short strings tell text from keys less well."""
    return (n >= 32) + (n >= 64)


def level_of(s: str, random_at: float = 0.001) -> int:
    """How small a candidate's p-value under ordinary text is, in steps; 0 if it doesn't pass for random."""
    p_random, p_text = battery(s)
    if p_random < random_at or p_text >= 1:
        return 0
    return min(STEPS * LEAST, int(-math.log10(max(p_text, 1e-300)) * STEPS))


def cuts(counts: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """Benjamini-Hochberg: the least level that is a discovery, for each length class with one.

    counts holds the candidates by (class, level). Of m candidates of a class, those of level l and above are
    discoveries if 10**(-l / STEPS) <= rate * their number / m, for the least l of which that is true.
    """
    out: dict[int, int] = {}
    for kind in {k for k, _ in counts}:
        levels = sorted(((level, n) for (k, level), n in counts.items() if k == kind), reverse=True)
        m, above = sum(n for _, n in levels), 0
        for level, n in levels:
            above += n
            if level and 10 ** (-level / STEPS) <= rate * above / m:
                out[kind] = level
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def scan_text(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int, int]]]:
    """(base spans, candidates (start, end, length class, level) that overlap none of them), in time linear in both."""
    if not text:
        return [], []
    base = base_spans(text)
    found, i, end = [], 0, 0
    for m in CANDIDATE.finditer(text):
        while i < len(base) and base[i][0] < m.end():  # end: how far the base spans that begin before the candidate's end reach
            end = max(end, base[i][1])
            i += 1
        if end <= m.start() and not m[0].rstrip("=").isdigit():
            found.append((m.start(), m.end(), length_class(m.end() - m.start()), level_of(m[0])))
    return base, found


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, candidates) of each document."""

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        candidate = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("level", pa.int32())]))
        for batch in pieces(batches, "text"):
            base, every = [], []
            for text in batch.column("text"):
                b, more = scan_text(text.as_py())
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in b])
                every.append([{"start": s, "end": e, "class": k, "level": v} for s, e, k, v in more])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(base, span), pa.array(every, candidate)], names=["id", "base", "candidates"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, base array<struct<start:long,end:long,kind:string>>, candidates array<struct<start:long,end:long,class:int,level:int>>")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.001) -> DataFrame:
    """(id, base, spans): arrays of (start, end, kind), by start and then kind; offsets in code points, end exclusive.

    base has the pattern matches, spans those and the ones that the battery adds: the discoveries among the candidates of
    all documents, by length class, of which ``rate`` at most are expected to be ordinary text. Only counts by class and
    level (some thousand numbers) come to the driver. A document's added spans so depend on the whole table, its base
    spans on its own text. Null and empty texts have none; texts are read whole, in linear time; repeated rows count each
    and fare alike; equal p-values are decided alike; other columns don't matter; an empty table gives an empty table.
    """
    found = stage(find_candidates(docs, id_col, text_col))
    levels = found.select(F.explode("candidates").alias("c")).groupBy("c.class", "c.level").agg(F.count(F.lit(1)).alias("n")).collect()
    least = cuts({(r["class"], r["level"]): r["n"] for r in levels}, rate)
    wanted = lambda c: F.coalesce(*[F.when((c["class"] == k) & (c["level"] >= v), True) for k, v in least.items()], F.lit(False))
    added = F.transform(F.filter("candidates", wanted), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("random").alias("kind")))
    place = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k).cast("int")
    key = lambda s: F.struct(s["start"].alias("start"), place(s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))
    ordered = F.transform(F.array_sort(F.transform(F.concat("base", added), key)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select(F.col("id").alias(id_col), "base", ordered.alias("spans"))


def redact(docs: DataFrame, spans_col: str = "spans", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """Text with each span replaced by ``mark``; overlapping spans are one."""

    @F.pandas_udf("string")
    def run(texts, spans):
        import pandas as pd

        out = []
        for text, found in zip(texts, spans, strict=True):
            if text is not None and found is not None and len(found):
                done, at = [], 0
                for x in sorted(found, key=lambda x: x["start"]):
                    if x["end"] > at:
                        if x["start"] >= at:
                            done += [text[at : x["start"]], mark]
                        at = x["end"]
                text = "".join([*done, text[at:]])
            out.append(text)
        return pd.Series(out)

    return docs.withColumn(text_col, run(F.col(text_col), F.col(spans_col)))
