"""Quality rules, line first: rules judge each line, failing lines go, and a document that loses too much text goes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.textops import WINDOW, pieces, raw, spans, windows, word_hashes

#: Characters that prose hardly has.
SYMBOLS = "#*$%&|<>"
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "all rights reserved",
    "enable javascript",
    "click here",
    "sign up for",
    "log in to",
    "subscribe to our newsletter",
    "share on facebook",
    "skip to content",
)
#: Line ends that close a sentence, also before quotes and brackets.
SENTENCE_END = r"[.!?:;…。][\"')\]”’»]*$"
#: Three or more short items between bars, arrows or bullets.
NAVIGATION = r"^[^|»›•>]{0,60}([|»›•>][^|»›•>]{0,60}){3,}$"

_END, _NAV, _SYM = re.compile(SENTENCE_END), re.compile(NAVIGATION), re.compile(f"[{re.escape(SYMBOLS)}]")
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)))


def line_fails(line: str, min_words: int = 4) -> str:
    """Name of the first rule that the line fails, or nothing. A line without words fails none.

    symbols: more symbol characters than a fifth of the line's words, four at least; navigation: items between bars;
    boilerplate: a known phrase; punctuation: fewer than ``min_words`` words and no sentence end, or no sentence end and
    no letter.
    """
    text = line.strip(" \t\n\r\x0b\x0c")
    if not text:
        return ""
    n = len(text.split())
    marks = len(_SYM.findall(text))
    if marks >= 4 and 5 * marks > n:
        return "navigation" if _NAV.match(text) else "symbols"
    if _NAV.match(text):
        return "navigation"
    if _BOILER.search(text.lower()):
        return "boilerplate"
    if not _END.search(text) and (n < min_words or not any(c.isalpha() for c in text)):
        return "punctuation"
    return ""


def clean_lines(text: str, min_words: int = 4) -> tuple[str, int, int]:
    """Text of the lines that pass, and the words in failing lines by characters: (kept, chars kept, chars in all)."""
    kept, got, total = [], 0, 0
    for line in text.split("\n"):
        size = len(line.strip())
        total += size
        if not line_fails(line, min_words):
            kept.append(line)
            got += size
    return "\n".join(kept), got, total


_OUT = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("clean_text", pa.string())]
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, clean_text string"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.5, min_words: int = 4, with_text: bool = True) -> DataFrame:
    """Counts, verdict and cleaned text of each document.

    Returns (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept[, clean_text]). kept is
    false if base_failed (n_words < 50 or more than half of the words in repeated 3-word windows), else true unless
    failing lines hold more than ``max_lost`` of the characters. clean_text is the text without failing lines, null if
    the document isn't kept. Null and empty texts count 0 throughout and fail the base rules. Each row is judged alone:
    repeated rows, ties and other columns change nothing. All of one text is held at once, and nothing else of it.
    """

    def run(batches):
        sym = np.zeros(256, bool)
        sym[list(SYMBOLS.encode())] = True
        for batch in pieces(batches, "text"):
            data, off = raw(batch.column("text"))
            starts, ends, ptr = spans(data, off)
            n = np.diff(ptr)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            of_words = np.concatenate([[0], np.cumsum(chars[ends] - chars[starts])])
            marks = np.concatenate([[0], np.cumsum(sym[data])])
            hashes = word_hashes(data, starts, ends)
            first = windows(ptr, 3)
            triples = WINDOW(hashes, first, first + 3) if len(first) else np.zeros(0, np.uint64)
            cut = np.searchsorted(first, ptr)
            texts = batch.column("text").to_pylist()
            cols: list[list] = [[] for _ in range(4)]
            for d, text in enumerate(texts):
                mine = triples[cut[d] : cut[d + 1]]
                repeated = 0
                if len(mine) > 1:
                    order = np.sort(mine)
                    twice = order[1:][order[1:] == order[:-1]]
                    if len(twice):
                        hit = np.zeros(int(n[d]) + 1, np.int64)
                        at = (first[cut[d] : cut[d + 1]] - ptr[d])[np.isin(mine, twice)]
                        np.add.at(hit, at, 1)
                        np.add.at(hit, at + 3, -1)
                        repeated = int((np.cumsum(hit)[:-1] > 0).sum())
                lines = (text or "").split("\n")
                full = [x for x in lines if x.strip(" \t\n\r\x0b\x0c")]
                failed = bool(n[d] < 50 or 100 * repeated > 50 * n[d])
                kept, clean = False, None
                if not failed:
                    clean, got, total = clean_lines(text, min_words)
                    kept = total - got <= max_lost * total
                cols[0].append(len(full) - len(set(full)))
                cols[1].append(repeated)
                cols[2].append(failed)
                cols[3].append((kept, clean if kept and with_text else None))
            out = [batch.column("id"), n, of_words[ptr[1:]] - of_words[ptr[:-1]], marks[off[1:]] - marks[off[:-1]], cols[0], cols[1], cols[2], [k for k, _ in cols[3]], [t for _, t in cols[3]]]
            yield pa.RecordBatch.from_arrays([out[0], *[pa.array(x, kind) for x, (_, kind) in zip(out[1:], _OUT, strict=True)]], names=["id", *[k for k, _ in _OUT]])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    out = slim.mapInArrow(run, f"id {kind}, {_DDL}").withColumnRenamed("id", id_col)
    return out if with_text else out.drop("clean_text")
