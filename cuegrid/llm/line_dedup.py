"""Operator 3: repeated runs of lines, found by winnowing and deleted where they come again.

Lines with words are hashed, stripped of blanks at both ends; lines without words never match
and stay. From every window of consecutive lines that just reaches ``min_words`` words, the
line of least hash (the last of equals) is a fingerprint, so any run of that many words shared
by two places shares a fingerprint at the same offset. Windows whose fingerprint has a hash that
comes again are keyed by the hash of all their lines, both those that just reach ``min_words``
words from their first line on and those that do so from their last line back: together they
cover every line of a repeated run. A window is joined to the first one of its key, in the order
of doc_id and line, and all but the first are deleted. So a line goes exactly if a run of
``min_words`` words that holds it came before, in whichever context; the first copy of a line
always stays.

Null text stays null and has no lines; empty text stays. Null ids come before all others. Rows
that repeat both id and text count as one document and lose the same lines; rows that repeat
an id with another text are ordered by a hash of it. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.common import rest_of, restored, slices, written

MIN_WORDS = 50
_BLANKS = b" \t\n\x0b\x0c\r"


def hashed_lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of every line with words."""
    h, n = [], []
    for line in text.encode().split(b"\n"):
        if line := line.strip(_BLANKS):
            h.append(xxhash.xxh64_intdigest(line))
            n.append(len(line.split()))
    return np.array(h, np.uint64).view(np.int64), np.array(n, np.int32)


def winnow(hashes: np.ndarray, words: np.ndarray, min_words: int = MIN_WORDS) -> list[int]:
    """Places of the last least hash of every shortest window of min_words words or more."""
    total = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(total, total[:-1] + min_words)  # the window of i holds lines i to ends[i] - 1
    out: list[int] = []
    least: list[int] = []  # places of the current window whose hash is below all later ones
    head = at = 0
    values = hashes.tolist()
    for i, end in enumerate(ends.tolist()):
        if end > len(values):
            break
        for k in range(at, end):
            while len(least) > head and values[least[-1]] >= values[k]:
                least.pop()
            least.append(k)
        at = max(at, end)
        while least[head] < i:
            head += 1
        if not out or out[-1] != least[head]:
            out.append(least[head])
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """row (the document's other columns), text, and what its lines are ordered by: whole-number
    ids by themselves, others by a hash."""
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    number = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return docs.select(rest_of(docs), F.col("text").alias("text"), F.coalesce(number, F.lit(-(1 << 63))).alias("_doc"), F.xxhash64("text").alias("_text"))


def lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_doc, _text, hashes, words, picks of each text that has a window of min_words words."""
    arrays = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc, key, text in zip(b["_doc"].to_pylist(), b["_text"].to_pylist(), b["text"]):
                h, n = hashed_lines(text.as_py())
                if len(h) and int(n.sum()) >= min_words:
                    rows.append((doc, key, h, n, winnow(h, n, min_words)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), *arrays))], names=["_doc", "_text", "hashes", "words", "picks"])

    keyed = _keyed(docs).filter(F.col("text").isNotNull()).select("_doc", "_text", "text")
    return keyed.mapInArrow(run, "_doc long, _text long, hashes array<long>, words array<int>, picks array<int>").dropDuplicates(["_doc", "_text"])


def windows(words: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """start, end of the shortest windows of min_words words from every line on, and of those back from every line."""
    total = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(total, total[:-1] + min_words)
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    on, back = np.flatnonzero(ends < len(total)), np.flatnonzero(starts >= 0)
    back = back[ends[starts[back]] != back + 1]  # the others are windows from their first line on
    return np.concatenate([on, starts[back]]), np.concatenate([ends[on], back + 1])


def candidates(lined: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_doc, _text, start, end, least, key: windows whose fingerprint's hash ``least`` comes again, keyed by all their lines."""
    picked = lined.select("_doc", "_text", "hashes", F.explode("picks").alias("_line")).select("_doc", "_text", F.get("hashes", F.col("_line")).alias("_hash"))
    again = picked.groupBy("_hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("_hash")
    held = picked.join(again, "_hash").groupBy("_doc", "_text").agg(F.collect_set("_hash").alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            docs, spans = [], []
            for i, (hashes, words, known) in enumerate(zip(b["hashes"], b["words"], b["again"])):
                h, known = hashes.values.to_numpy(), set(known.as_py())
                least = {}  # by the first line: each window holds the one from its first line on
                for s, e in zip(*(x.tolist() for x in windows(words.values.to_numpy(), min_words))):
                    if s not in least:
                        least[s] = int(h[s:e].min())
                    if least[s] in known:
                        docs.append(i)
                        spans.append((s, e, least[s], xxhash.xxh64_intdigest(h[s:e].tobytes())))
            start, end, low, key = zip(*spans) if spans else [[]] * 4
            at = pa.array(docs, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b["_doc"].take(at), b["_text"].take(at), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(low, pa.int64()), pa.array(np.array(key, np.uint64).view(np.int64))],
                names=["_doc", "_text", "start", "end", "least", "key"],
            )

    asked = lined.select("_doc", "_text", "hashes", "words").join(held, ["_doc", "_text"])
    return asked.mapInArrow(run, "_doc long, _text long, start int, `end` int, least long, key long")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_doc, _text, runs: array of (start, end) over the lines with words, all to be deleted; runs do not touch."""
    keyed = written(candidates(written(lines(docs, min_words), "lines"), min_words), "windows")
    place = F.struct("_doc", "_text", "start")
    first = keyed.groupBy("least", "key").agg(F.min(place).alias("first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    later = keyed.join(first, ["least", "key"]).filter(place != F.col("first"))
    found = later.groupBy("_doc", "_text").agg(F.collect_set(F.struct("start", "end")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            runs = pa.array([joined_runs(r) for r in b["runs"].to_pylist()], b.schema.field("runs").type)
            yield b.set_column(2, b.schema.field("runs"), runs)

    return found.mapInArrow(run, found.schema)


def joined_runs(runs: list[dict]) -> list[dict]:
    """The runs with those that overlap or touch as one."""
    out: list[dict] = []
    for r in sorted(runs, key=lambda r: r["start"]):
        if out and r["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], r["end"])
        else:
            out.append(dict(r))
    return out


def without_runs(text: str, runs: list[dict]) -> tuple[str, int]:
    """The text without the runs' lines, and how many lines went."""
    gone = {k for r in runs for k in range(r["start"], r["end"])}
    out, k = [], -1
    for line in text.split("\n"):
        full = bool(line.strip(_BLANKS.decode()))
        k += full
        if not (full and k in gone):
            out.append(line)
    return "\n".join(out), len(gone)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row (the document's other columns), text (shortened), runs (null where none) and removed (lines) of every document."""
    joined = _keyed(docs).join(repeated_runs(docs, min_words), ["_doc", "_text"], "left").select("row", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, runs = b["text"].to_pylist(), b["runs"].to_pylist()
            removed = [0] * len(texts)
            for i, r in enumerate(runs):
                if r:
                    texts[i], removed[i] = without_runs(texts[i], r)
            b = b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(texts, pa.string()))
            yield b.append_column("removed", pa.array(removed, pa.int32()))

    return joined.mapInArrow(run, joined.withColumn("removed", F.lit(0)).schema)


def shortened(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with shortened texts; n_chars follows."""
    out = dedup_lines(docs, min_words)
    return out.select(*restored(out, docs))
