"""Operator 9: secrets in texts, by fixed patterns and by tests of randomness.

The patterns give the base spans. Further candidates are runs of 20 characters or more of the
usual encodings outside them. Each is tested in the alphabet of its inferred encoding for
uniform use of its characters (chi-squared), for runs about the alphabet's middle, and for
serial correlation; the sum of the three log p-values is its score, 0 at most. Each candidate
brings a decoy: as many letters and digits of the text around it, without the base spans and
candidates there; where the text has too few (a list of keys), it brings none. Per encoding and
class of lengths each distinct candidate and decoy counts once. The share of decoys that reach a
score, with one added, gives how many candidates would by chance; the threshold is the lowest
score at which these are no more than the accepted share of the candidates that reach it. So
short runs, whose tests are weak, need more, and a class of few candidates or decoys accepts none.

Null text counts as empty: no spans. Texts of any length are scanned whole, in one row each. Repeated
rows are scanned each; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import slices, texts, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
#: The leftmost runs of the least length or more are those that the open patterns find.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
NOT_ALNUM = re.compile(r"[^A-Za-z0-9]+")
#: Inferred encodings in the order tried: name, alphabet in order.
_UP, _LOW, _NUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", _NUM + "abcdef"),
    ("HEX", _NUM + "ABCDEF"),
    ("base32", _UP + "234567"),
    ("base36", _NUM + _LOW),
    ("BASE36", _NUM + _UP),
    ("base62", _NUM + _UP + _LOW),
    ("base64", _UP + _LOW + _NUM + "+/"),
    ("base64url", _UP + _LOW + _NUM + "-_"),
)
FALSE_SHARE = 0.02
#: Scores are kept to a tenth of a nat, down to this.
LOWEST = -600
SPAN = "struct<start:int, kind:int, `end`:int>"
CANDIDATES = "array<struct<start:int, `end`:int, encoding:int, size:int, score:int, decoy:int, key:bigint, draw:bigint>>"


def assigned(text: str) -> Iterator[tuple[int, int]]:
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 6:
                yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, number of the kind, end; by start and kind."""
    found = [(a, 0, b) for a, b in assigned(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def infer(run: str) -> int | None:
    """The first encoding whose alphabet holds the run, which must mix digits and letters."""
    body = run.rstrip("=")
    if not any(c in _NUM for c in body) or not any(c.isalpha() for c in body):
        return None
    used = set(body)
    return next((k for k, (_, alphabet) in enumerate(ENCODINGS) if used <= set(alphabet)), None)


def _two_sided(z: float) -> float:
    return math.log(max(math.erfc(abs(z) / math.sqrt(2)), 1e-20))


def score(run: str, alphabet: str) -> int:
    """Tenths of the sum of the log p-values of the three tests under randomness."""
    place = {c: i for i, c in enumerate(alphabet)}
    x = [place[c] for c in run if c in place]
    n, a = len(x), len(alphabet)
    if n < 8:
        return LOWEST
    counts = [0] * a
    for i in x:
        counts[i] += 1
    chi = sum((c - n / a) ** 2 for c in counts) / (n / a)
    # Wilson and Hilferty: the cube root of chi-squared over its freedom is nearly normal.
    f = a - 1
    z = ((chi / f) ** (1 / 3) - (1 - 2 / (9 * f))) / math.sqrt(2 / (9 * f))
    p = math.log(max(math.erfc(z / math.sqrt(2)) / 2, 1e-20))
    high = [2 * i >= a for i in x]
    up = sum(high)
    down = n - up
    if up and down:
        runs = 1 + sum(b != c for b, c in zip(high, high[1:]))
        mean = 2 * up * down / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p += _two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 0
    else:
        p += n * math.log(0.5)
    m = sum(x) / n
    spread = sum((i - m) ** 2 for i in x)
    p += _two_sided(math.sqrt(n) * sum((b - m) * (c - m) for b, c in zip(x, x[1:])) / spread) if spread else -20
    return max(LOWEST, math.floor(10 * p))


def size_class(n: int) -> int:
    """Lengths by halves of powers of two."""
    return math.floor(2 * math.log2(n))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Runs outside the base spans; decoy (null where the text has none) and draw are the score and hash of the decoy."""
    found, at = [], 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(base) and base[at][2] <= s:
            at += 1
        if any(b[0] < e and b[2] > s for b in base[at:]):
            continue
        k = infer(m[0])
        if k is not None:
            found.append((s, e, k))
    if not found:
        return []
    # The letters and digits of the text beside all spans, and how many come before each candidate.
    kept, before, at, n = [], {}, 0, 0
    for s, e in sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, _ in found]):
        if s > at:
            kept.append(NOT_ALNUM.sub("", text[at:s]))
            n += len(kept[-1])
        before[s] = n
        at = max(at, e)
    rest = "".join(kept) + NOT_ALNUM.sub("", text[at:])
    out = []
    for s, e, k in found:
        n, alphabet = e - s, ENCODINGS[k][1]
        decoy = draw = None
        if len(rest) >= n:
            first = max(0, min(before[s] - n, len(rest) - n))
            near = rest[first : first + n]
            # A decoy in lower case reads as the encoding does where that has no lower case.
            near = near if any(c in alphabet for c in _LOW[6:]) or k == 0 else near.upper()
            decoy, draw = score(near, alphabet), _key(near)
        out.append({"start": s, "end": e, "encoding": k, "size": size_class(n), "score": score(text[s:e], alphabet), "decoy": decoy, "key": _key(text[s:e]), "draw": draw})
    return out


def _key(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and further candidates of each whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    cand = pa.list_(pa.struct([*((c, pa.int32()) for c in ("start", "end", "encoding", "size", "score", "decoy")), *((c, pa.int64()) for c in ("key", "draw"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            base = [base_spans(t) for t in (t.as_py() for t in b["text"])]
            more = [candidates(t.as_py(), s) for t, s in zip(b["text"], base)]
            base = [[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in base]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(base, span), pa.array(more, cand)], names=["doc_id", "base", "candidates"])

    return texts(docs).mapInArrow(run, f"doc_id {kind}, base array<{SPAN}>, candidates {CANDIDATES}")


def thresholds(scanned: DataFrame, false_share: float = FALSE_SHARE) -> dict[tuple[int, int], int]:
    """(encoding, size class): lowest score accepted. At most 8 encodings by some 60 classes."""
    c = scanned.select(F.explode("candidates").alias("c"))
    each = F.array(F.struct(F.col("c.score").alias("score"), F.col("c.key").alias("key"), F.lit(0).alias("decoy")), F.struct(F.col("c.decoy").alias("score"), F.col("c.draw").alias("key"), F.lit(1).alias("decoy")))
    scores = c.select("c.encoding", "c.size", F.explode(each).alias("s")).filter("s.key IS NOT NULL").select("encoding", "size", "s.score", "s.key", "s.decoy").distinct()
    hist = scores.groupBy("encoding", "size", "score").agg(F.sum(1 - F.col("decoy")).alias("real"), F.sum("decoy").alias("decoy"))
    whole = Window.partitionBy("encoding", "size")
    down = whole.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    reached = hist.select("encoding", "size", "score", *[F.sum(c).over(w).alias(n) for c, w, n in (("real", down, "real"), ("decoy", down, "decoy"), ("real", whole, "all_real"), ("decoy", whole, "all_decoy"))])
    by_chance = (F.col("decoy") + 1) / (F.col("all_decoy") + 1) * F.col("all_real")
    ok = reached.filter((by_chance <= false_share * F.col("real")) & (F.col("score") > LOWEST))
    return {(r.encoding, r.size): r.score for r in ok.groupBy("encoding", "size").agg(F.min("score").alias("score")).collect()}


def find(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, spans: array of (start, kind, end), by start and kind; kinds as in KINDS."""
    scanned = written(scan(docs), "scanned")
    limits = thresholds(scanned, false_share)
    added = F.filter("candidates", lambda c: _accepted(c, limits))
    more = F.transform(added, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return scanned.select("doc_id", F.array_sort(F.concat("base", more)).alias("spans"))


def _accepted(c, limits: dict[tuple[int, int], int]):
    if not limits:
        return F.lit(False)
    known = F.create_map(*[F.lit(x) for (k, size), least in limits.items() for x in (k * 1000 + size, least)])
    return F.coalesce(c["score"] >= known[c["encoding"] * 1000 + c["size"]], F.lit(False))


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """Overlapping and touching spans together become one mask."""
    out, at, end = [], 0, -1
    for s, e in sorted(spans):
        if s > end:
            out += [text[at:s], mask]
        end = max(end, e)
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, mask: str = "[SECRET]", false_share: float = FALSE_SHARE) -> DataFrame:
    """docs with every span of its text replaced by the mask; null texts stay null, n_chars follows."""
    limits = thresholds(scan(docs), false_share)
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b["text"].to_pylist()
            for i, t in enumerate(texts):
                if t:
                    base = base_spans(t)
                    more = [c for c in candidates(t, base) if c["score"] >= limits.get((c["encoding"], c["size"]), 1)]
                    if base or more:
                        texts[i] = masked(t, [(s, e) for s, _, e in base] + [(c["start"], c["end"]) for c in more], mask)
            yield b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(texts, pa.string()))

    out = out.mapInArrow(run, out.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
