"""Secret scan: fixed patterns, and a battery of randomness tests under false-discovery control."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .registry import query

# fixed values: the base patterns
_ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
# end of fixed values
#: '=' only ends a candidate (as padding), so the value of NAME=VALUE stands by itself.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")

#: Alphabets from narrow to wide; the first that holds a whole candidate is its encoding.
ENCODINGS = (("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"), ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
             ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"))
_PLACES = [(name, {c: i for i, c in enumerate(letters)}) for name, letters in ENCODINGS]
#: A candidate that fails one of the tests at this level (after correction for three) isn't random.
LEVEL = 0.01
#: Share of false finds accepted, for each encoding and length band.
FALSE_SHARE = 0.01
_BANDS, _BINS = (24, 32, 48, 64), 400
#: Plain writing as a chain of letter classes (lower, upper, digit, mark): chance of the next class, and letters in each.
_NEXT = ((0.94, 0.02, 0.02, 0.02), (0.60, 0.34, 0.03, 0.03), (0.04, 0.03, 0.88, 0.05), (0.45, 0.20, 0.20, 0.15))
_FIRST, _LETTERS = (0.55, 0.25, 0.15, 0.05), (26, 26, 10, 5)


def _tail(z: float) -> float:
    """Two-sided normal p-value."""
    return math.erfc(abs(z) / math.sqrt(2))


def encoding(s: str) -> tuple[str, list[int], int] | None:
    """(name, symbols, size) of the narrowest alphabet that holds ``s`` (padding apart), or None."""
    body = s.rstrip("=")
    for name, at in _PLACES:
        if all(c in at for c in body):
            return name, [at[c] for c in body], len(at)
    return None


def battery(symbols: list[int], size: int) -> float:
    """Corrected p-value of the hypothesis that ``symbols`` are uniform and independent: chi-squared of the counts
    (with the exact mean and variance of few symbols), runs above and below the middle, serial correlation."""
    n, counts = len(symbols), [0] * size
    for x in symbols:
        counts[x] += 1
    chi = size / n * sum(c * c for c in counts) - n
    p_chi = 0.5 * math.erfc((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (1 - 1 / n)) / math.sqrt(2))
    up = [2 * x >= size for x in symbols]
    a, runs = sum(up), 1 + sum(x != y for x, y in zip(up, up[1:], strict=False))
    if a in (0, n):
        return 0.0
    mean = 1 + 2 * a * (n - a) / n
    p_runs = _tail((runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9)))
    middle = sum(symbols) / n
    spread = sum((x - middle) ** 2 for x in symbols)
    serial = sum((x - middle) * (y - middle) for x, y in zip(symbols, symbols[1:], strict=False)) / spread if spread else 1.0
    return min(1.0, 3 * min(p_chi, p_runs, _tail((serial + 1 / n) * math.sqrt(n))))


def evidence(s: str, size: int) -> float:
    """Log likelihood ratio of uniform symbols against plain writing; exp(-evidence) bounds the p-value of writing."""
    kinds = [0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in s.rstrip("=")]
    writing = math.log(_FIRST[kinds[0]]) + sum(math.log(_NEXT[x][y]) for x, y in zip(kinds, kinds[1:], strict=False)) - sum(math.log(_LETTERS[k]) for k in kinds)
    return -len(kinds) * math.log(size) - writing


def base(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(s, ("assign", "access", "hex")[k], e) for s, k, e in sorted(found)]


def candidates(text: str) -> list[tuple[int, int, str, int, bool]]:
    """(start, end, stratum, bin of the evidence, passes the battery) of long tokens of at least two letter classes."""
    out = []
    for m in _CANDIDATE.finditer(text):
        s = m.group()
        if s.isalpha() and (s.islower() or s.isupper() or s[1:].islower()) or s.isdigit() or not s.rstrip("="):
            continue
        kind = encoding(s)
        if kind and len(kind[1]) >= 16:
            band = sum(len(kind[1]) >= b for b in _BANDS)
            out.append((m.start(), m.end(), f"{kind[0]}{band}", min(_BINS, max(0, int(4 * evidence(s, kind[2])))), battery(kind[1], kind[2]) >= LEVEL))
    return out


_SPAN = "array<struct<start:int,kind:string,end:int>>"
_CAND = "array<struct<start:int,end:int,stratum:string,bin:int,random:boolean>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
    cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.string()), ("bin", pa.int32()), ("random", pa.bool_())]))
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        fixed = [base(t) for t in texts]
        digest = [hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in x).encode()).hexdigest() for x in fixed]
        more = [candidates(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in fixed], span), pa.array(digest, pa.string()),
                                          pa.array([[dict(zip(("start", "end", "stratum", "bin", "random"), c, strict=True)) for c in x] for x in more], cand)], names=["doc_id", "base", "base_sha256", "candidates"])


def cutoffs(scanned: DataFrame, share: float = FALSE_SHARE) -> dict[str, int]:
    """The smallest evidence bin that is accepted in each stratum (encoding and length band).

    Benjamini-Hochberg over all candidates of the corpus: with p at most exp(-bin / 4) for a bin, the cutoff is the
    lowest bin whose p stays below share * (candidates at or above it) / (all of the stratum). Bins are counted in a
    distributed way; the driver sees a count for each bin, at most 401 for each of 35 strata.
    """
    bins = scanned.select(F.explode("candidates").alias("c")).groupBy("c.stratum", "c.bin").count().collect()
    out = {}
    for stratum in sorted({b[0] for b in bins}):
        counts = {b[1]: b[2] for b in bins if b[0] == stratum}
        total, above = sum(counts.values()), 0
        for k in sorted(counts, reverse=True):
            above += counts[k]
            if math.exp(-k / 4) <= share * above / total:
                out[stratum] = k
    return out


def secrets(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """Per row of ``docs``: doc_id, base (spans of the fixed patterns), base_sha256, spans (all, with kind random too).

    Candidates for kind random are tokens of 16 or more symbols of an encoding and two letter classes; they are kept if
    no randomness test rejects them and they stand out from writing under the false-discovery cutoff of their encoding
    and length. A name and what follows its '=' are two tokens. What overlaps a fixed pattern isn't added. Offsets are code points, ends exclusive. A null text counts
    as empty; rows that repeat are scanned alike; an empty table gives no rows.
    """
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {_SPAN}, base_sha256 string, candidates {_CAND}"
    scanned = cut(docs.select("doc_id", "text").mapInArrow(_scan, kind))
    limits = cutoffs(scanned, share)
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.create_map().cast("map<string,int>")
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    random = F.filter("candidates", lambda c: c["random"] & (c["bin"] >= F.coalesce(limit[c["stratum"]], F.lit(_BINS + 1))) & free(c))
    added = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit("random").alias("kind"), c["end"].alias("end")))
    order = F.create_map(*[F.lit(x) for kv in (("assign", 0), ("access", 1), ("hex", 2), ("random", 3)) for x in kv])
    keyed = F.array_sort(F.transform(F.concat("base", added), lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return scanned.select("doc_id", "base", "base_sha256", F.transform(keyed, lambda s: F.struct(s["start"], s["kind"], s["end"])).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op9_random_secrets")
def op9(spark: SparkSession, path: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secrets(table(spark, path, "documents")).select("doc_id", count("assign"), count("access"), count("hex"), "base_sha256", joined(F.col("spans")).alias("spans"))
