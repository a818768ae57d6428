"""SimHash near-duplicates by the generalised pigeonhole principle (Qin et al., GPH, ICDE 2018).

Fingerprints within ``tau`` bits are linked. The 64 bits are cut into ``m`` parts, correlated bits
together. If part ``i`` gets a threshold ``t_i >= -1`` and the thresholds add up to ``tau - m + 1``,
two linked fingerprints differ by at most ``t_i`` bits in some part: else they would differ by
``sum(t_i + 1) = tau + 1`` bits at least. Each fingerprint gets its own thresholds by dynamic
programming over estimated candidate counts, so it does not probe where its value is frequent.

1. Fingerprint every document; work on distinct fingerprints from then on, so that copies, however
   many, are one row.
2. Count bit pairs (64 x 64 numbers) and group correlated bits; count values of each part (at most
   ``m * 2**16`` numbers, wider parts by their first 16 bits). Both sizes are fixed.
3. Link each fingerprint with a few centres of its parts' buckets where they are within ``tau``, and
   group it with the smallest centre within two such links: dense clouds of near copies collapse with one
   link a member and not one a pair.
4. Probe: every fingerprint looks up all part values within its thresholds; hits are verified on all
   64 bits inside the join, which returns only links between different groups of step 3.
5. Components of the links; each document gets the smallest ``doc_id`` of its component.

Defined results: null and empty texts have fingerprint 0; a null ``doc_id`` is a member like any
other and never the component id unless all are null; repeated rows are equal members; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerlens.llm.text import map_rows, space_words
from ledgerlens.operators.graph.components import star_components
from ledgerlens.session import cut_lineage

SHINGLE = 4
MAX_BITS = 4
PARTS = 3
SEED = 42
#: Bits of a part that are counted one by one; further bits are taken as even.
COUNTED_BITS = 16
#: Orders in which bucket centres are drawn.
CENTRES = (0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x14057B7EF767814F)
_BLOCK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included."""
    words = space_words(text)
    if not words:
        return 0
    total = max(1, len(words) - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, total, _BLOCK):
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words[j:j + size]), SEED)
                      for j in range(lo, min(total, lo + _BLOCK))], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, _fp`` (the fingerprint as a signed long)."""
    id_type = dict(docs.dtypes)["doc_id"]

    def rows(columns):
        return [(i, f - (1 << 64) if f >> 63 else f)
                for i, t in zip(*columns) for f in [fingerprint(t, size)]]

    return map_rows(docs, rows, f"doc_id {id_type}, _fp long", ["doc_id", "text"])


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp, dtype="<i8").view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")


def group_bits(pairs: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Cut 64 bits into ``m`` parts: each grows by the bit most correlated with those it has."""
    p = np.diag(pairs) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((pairs / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, parts = list(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        part = [max(left, key=lambda b: (corr[b, left].max(), -b))]
        left.remove(part[0])
        while len(part) < size:
            best = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        parts.append(part)
    return parts


@lru_cache(maxsize=None)
def ball(width: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)],
                    dtype=np.int64)


def _binomials(n: int, top: int) -> list[int]:
    out = [1]
    for k in range(1, top + 1):
        out.append(out[-1] * (n - k + 1) // k)
    return out


class Plan:
    """Parts, and estimated candidate counts of each part value and threshold."""

    def __init__(self, parts: list[list[int]], counts: list[np.ndarray], tau: int):
        self.parts, self.tau = parts, tau
        self.tables = []
        for bits, n in zip(parts, counts):
            counted = min(len(bits), COUNTED_BITS)
            shells = np.zeros((tau + 1, 1 << counted))
            shells[0] = n
            at = np.arange(1 << counted)
            for b in range(counted):
                moved = shells[:, at ^ (1 << b)]
                shells[1:] = shells[1:] + moved[:-1]
            rest = len(bits) - counted
            even = np.array(_binomials(rest, tau)) / (1 << rest)
            within = np.stack([sum(shells[a] * even[t - a] for a in range(t + 1)) for t in range(tau + 1)])
            # Column 0 is threshold -1: no probe. A probe itself costs as much as a candidate.
            probes = np.array([len(ball(len(bits), t)) for t in range(tau + 1)])[:, None]
            self.tables.append(np.vstack([np.zeros(1 << counted), np.cumsum(within, axis=0) + probes]).astype(
                np.float32))

    def values(self, fp: np.ndarray) -> list[np.ndarray]:
        bits = bits_of(fp).astype(np.int64)
        return [bits[:, p] @ (np.int64(1) << np.arange(len(p))) for p in self.parts]

    def thresholds(self, values: list[np.ndarray]) -> np.ndarray:
        """Per fingerprint and part; each row adds up to ``tau - m + 1`` and costs least."""
        n, total = len(values[0]), self.tau + 1
        best = np.full((n, total + 1), np.inf)
        best[:, 0] = 0
        picks = []
        for value, table in zip(values, self.tables):
            cost = table[:, value & (table.shape[1] - 1)].T
            options = np.full((n, total + 1, total + 1), np.inf)
            for k in range(total + 1):
                options[:, k:, k] = best[:, :total + 1 - k] + cost[:, k:k + 1]
            picks.append(options.argmin(axis=2))
            best = options.min(axis=2)
        out = np.zeros((n, len(values)), dtype=np.int64)
        at = np.full(n, total)
        for i in reversed(range(len(values))):
            k = picks[i][np.arange(n), at]
            out[:, i] = k - 1
            at = at - k
        return out

    def key(self, part: int, value: np.ndarray) -> np.ndarray:
        return (np.int64(part) << 40) | value


def _plan(fps: DataFrame, m: int, tau: int) -> Plan:
    def pair_counts(frames):
        total = np.zeros((64, 64))
        for pdf in frames:
            b = bits_of(pdf["_fp"].to_numpy()).astype(np.float32)
            total += b.T @ b
        i, j = np.indices((64, 64)).reshape(2, -1)
        yield pd.DataFrame({"i": i, "j": j, "n": total.reshape(-1).astype(np.int64)})

    sums = fps.select("_fp").mapInPandas(pair_counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    pairs = np.zeros((64, 64))
    for r in sums.collect():
        pairs[r.i, r.j] = r.n
    parts = group_bits(pairs, fps.count(), m)
    empty = Plan(parts, [np.zeros(1 << min(len(p), COUNTED_BITS)) for p in parts], tau)

    def value_counts(frames):
        seen = [np.zeros(1 << min(len(p), COUNTED_BITS), dtype=np.int64) for p in parts]
        for pdf in frames:
            for s, v in zip(seen, empty.values(pdf["_fp"].to_numpy())):
                s += np.bincount(v & (len(s) - 1), minlength=len(s))
        for i, s in enumerate(seen):
            at = np.flatnonzero(s)
            yield pd.DataFrame({"i": np.full(len(at), i, dtype=np.int32), "v": at, "n": s[at]})

    counts = [np.zeros(1 << min(len(p), COUNTED_BITS)) for p in parts]
    got = fps.select("_fp").mapInPandas(value_counts, "i int, v long, n long").groupBy("i", "v").agg(F.sum("n").alias("n"))
    for i, own in got.toPandas().groupby("i"):
        counts[i][own["v"].to_numpy()] = own["n"].to_numpy()
    return Plan(parts, counts, tau)


def links(fps: DataFrame, tau: int = MAX_BITS, m: int = PARTS) -> DataFrame:
    """Components of the distinct fingerprints ``_fp``: ``(id, component)`` of every one."""
    if not 2 <= m <= 16:
        raise ValueError("2 to 16 parts")
    plan = fps.sparkSession.sparkContext.broadcast(_plan(fps, m, tau))

    def index(frames):
        for pdf in frames:
            fp = pdf["_fp"].to_numpy()
            for i, v in enumerate(plan.value.values(fp)):
                yield pd.DataFrame({"_key": plan.value.key(i, v), "_fp": fp, "_group": pdf["_group"]})

    def probes(frames):
        p = plan.value
        for pdf in frames:
            for lo in range(0, len(pdf), 2000):
                part = pdf.iloc[lo:lo + 2000]
                fp, group = part["_fp"].to_numpy(), part["_group"].to_numpy()
                values = p.values(fp)
                t = p.thresholds(values)
                for i, v in enumerate(values):
                    for r in range(p.tau + 1):
                        own = np.flatnonzero(t[:, i] == r)
                        masks = ball(len(p.parts[i]), r)
                        step = max(1, 200_000 // len(masks))
                        for a in range(0, len(own), step):
                            o = own[a:a + step]
                            yield pd.DataFrame({"_key": p.key(i, (v[o][:, None] ^ masks[None, :]).reshape(-1)),
                                                "_pfp": np.repeat(fp[o], len(masks)),
                                                "_pgroup": np.repeat(group[o], len(masks))})

    rows = "_key long, _fp long, _group long"
    plain = fps.select("_fp", F.col("_fp").alias("_group")).mapInPandas(index, rows).drop("_group")
    apart = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    centres = plain.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(*[F.min(F.col("_fp").bitwiseXOR(F.lit(c))).bitwiseXOR(F.lit(c)) for c in CENTRES]).alias("_c"))
    near = cut_lineage(
        plain.join(centres.where("_n > 1"), "_key")
             .select("_fp", F.explode(F.array_distinct("_c")).alias("_centre"))
             .where((F.col("_fp") != F.col("_centre")) & (apart("_fp", "_centre") <= tau)).distinct())
    # A fingerprint's group: the smallest centre that it reaches in two steps. Equal groups are connected.
    one = near.groupBy("_fp").agg(F.min("_centre").alias("_one"))
    two = (near.join(one.withColumnRenamed("_fp", "_centre"), "_centre", "left")
               .groupBy("_fp").agg(F.min(F.least("_centre", F.coalesce("_one", "_centre"))).alias("_group")))
    grouped = cut_lineage(
        fps.select("_fp").join(two, "_fp", "left").select("_fp", F.least("_fp", F.coalesce("_group", "_fp")).alias("_group")))
    # Few bytes, many probes: the planner would put them into very few tasks.
    spread = grouped.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_fp")
    # By their input's few bytes the probes, many for each fingerprint, would pass for a small table to broadcast.
    found = grouped.mapInPandas(index, rows).join(
        spread.mapInPandas(probes, "_key long, _pfp long, _pgroup long").hint("merge"), "_key").where(
        (F.col("_fp") > F.col("_pfp")) & (F.col("_group") != F.col("_pgroup")) & (apart("_fp", "_pfp") <= tau))
    edges = (found.select(F.col("_group").alias("src"), F.col("_pgroup").alias("dst"))
             .unionByName(grouped.where("_fp != _group").select(F.col("_fp").alias("src"), F.col("_group").alias("dst"))))
    whole = (fps.select(F.col("_fp").alias("id")).join(star_components(edges), "id", "left")
                .select("id", F.coalesce("component", "id").alias("component")))
    return cut_lineage(whole)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, tau: int = MAX_BITS, m: int = PARTS) -> DataFrame:
    """Per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id``."""
    each = cut_lineage(fingerprints(docs, size))
    fps = cut_lineage(each.groupBy("_fp").agg(F.min("doc_id").alias("_least")))
    groups = links(fps, tau, m).withColumnRenamed("id", "_fp")
    # Written, so that the join below can split a component that holds many fingerprints.
    least = cut_lineage(groups.join(fps, "_fp").groupBy("component").agg(F.min("_least").alias("component_id")))
    ids = groups.join(least, "component").select("_fp", "component_id")
    return each.join(ids, "_fp").select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, tau: int = MAX_BITS, m: int = PARTS) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is the smallest of its component, columns unchanged.

    Rows are known by their id: rows that share one stay or go together."""
    winners = (near_duplicates(docs, size, tau, m)
               .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
               .select(F.col("doc_id").alias("_winner")).distinct())
    return docs.join(winners, docs["doc_id"].eqNullSafe(winners["_winner"]), "left_semi")
