"""Consensus of a read family: the family's central read, refined by what the aligned reads say, with its agreement.

Equal reads of a family are one row with a count before the shuffle, so a family costs what its different reads cost. Each
task takes whole families one after the other and aligns the reads of many at a time.

Reads have an order. Where counts tie, the value that reaches the count first wins: the one whose last read comes first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nucleotides import IUPAC, IUPAC_COMPLEMENT
from . import alignment

#: Letters of a word in the profile, passes of refinement, and the share of reads that must agree with a pair.
WORD, PASSES, PAIR_SHARE = 6, 3, 0.7
#: Scores of a primer against the start of a consensus.
_ANY = np.full(256, 15, np.uint8)
_ANY[[ord(c) for c in "ACGT"]] = [1, 2, 4, 8]
PRIMER_SCORES = alignment.Scores(match=0, mismatch=-100_000, gap=100_000, edge_gap=50_000, compatible=-1, masks=_ANY)
#: Letters of a sequence beyond its primer's that are aligned with the primer.
PRIMER_SLACK = 3
#: Letters of reads that are aligned together.
BATCH_LETTERS = 1_000_000
_COMPLEMENT = str.maketrans(IUPAC, IUPAC_COMPLEMENT)


class Read(NamedTuple):
    """A sequence, how many reads have it, and the places of the first and the last of them in the family."""

    sequence: str
    n: int
    first: int
    last: int


class Site(NamedTuple):
    """A place of the oriented consensus, from 1, with low agreement: the most frequent letter there and its run."""

    position: int
    agreement: float
    modal_base: str
    run_length: int


class Consensus(NamedTuple):
    sequence: str
    agreement: float
    sites: list[Site]


def mode(values: list[str], reads: list[Read]) -> str:
    """The most frequent value over reads; of equal ones the first to reach that count."""
    found: dict[str, list[int]] = {}
    for value, read in zip(values, reads):
        entry = found.setdefault(value, [0, read.last])
        entry[0] += read.n
        entry[1] = max(entry[1], read.last)
    return min(found, key=lambda v: (-found[v][0], found[v][1])) if found else ""


def profile(sequence: str) -> np.ndarray:
    """How often each word of WORD letters occurs; other letters than ACGT end words."""
    code = np.full(256, -1, np.int64)
    code[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3] * 2
    letters = code[np.frombuffer(sequence.encode("latin-1", "replace"), np.uint8)]
    n = len(letters) - WORD + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(letters, WORD)
    return (windows @ 4 ** np.arange(WORD - 1, -1, -1))[(windows >= 0).all(axis=1)]


def central(reads: list[Read]) -> str:
    """The read nearest to the mean of all profiles (ties: the first), by squared distance over total words."""
    words = [profile(r.sequence) for r in reads]
    bins, at = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.zeros((len(reads), len(bins)))
    np.add.at(counts, (np.repeat(np.arange(len(reads)), [len(w) for w in words]), at), 1)
    n = np.array([r.n for r in reads])
    mean, totals = n @ counts / n.sum(), counts.sum(axis=1)
    squared = (mean**2).sum() + (counts**2).sum(axis=1) - 2 * counts @ mean
    total = totals + (n @ totals) / n.sum()
    distance = np.divide(squared, WORD * total, out=np.zeros(len(reads)), where=total > 0)
    near = np.flatnonzero(distance <= distance.min() + 1e-12)
    return reads[min(near.tolist(), key=lambda k: reads[k].first)].sequence


class Aligned(NamedTuple):
    """A read against a candidate: letters of the read before each letter of the candidate, and up to it."""

    before: np.ndarray
    until: np.ndarray


def overhang(values: list[str], reads: list[Read], front: bool) -> str:
    """What most reads have beyond an end of the candidate: the mode of what is there, grown while most reads go on beyond it."""
    total, found = sum(r.n for r in reads), ""
    for _ in range(max(map(len, values), default=0) + 1):
        active = [k for k, value in enumerate(values) if value]
        if 2 * sum(reads[k].n for k in active) <= total:
            break
        reads = [reads[k] for k in active]
        values = [values[k] for k in active]
        total = sum(r.n for r in reads)
        found = mode(values, reads)
        rest = []
        for value, path in zip(values, alignment.steps([(found, value) for value in values])):
            before, until = alignment.places(path)
            rest.append(value[: before[0]] if front else value[until[-1] :])
        if rest == values:
            break
        values = rest
    return found


def _letters(reads: list[Read]) -> np.ndarray:
    width = max(len(r.sequence) for r in reads) + 2
    out = np.zeros((len(reads), width), np.uint8)
    for row, r in zip(out, reads):
        row[: len(r.sequence)] = np.frombuffer(r.sequence.encode("latin-1", "replace"), np.uint8)
    return out


def refined(candidate: str, reads: list[Read], found: list[Aligned]) -> str:
    """The candidate with stretches replaced by the reads' mode where too few of them agree with a pair of neighbours."""
    if len(candidate) < 2:
        return candidate
    n, own = np.array([r.n for r in reads]), np.frombuffer(candidate.encode("latin-1", "replace"), np.uint8)
    before, until = np.stack([x.before for x in found]), np.stack([x.until for x in found])
    letters, row = _letters(reads), np.arange(len(reads))[:, None]
    start = before[:, :-1]
    pair = (until[:, 1:] - start == 2) & (letters[row, start] == own[:-1]) & (letters[row, start + 1] == own[1:])
    weak = (n @ pair) / n.sum() < PAIR_SHARE
    bad = np.zeros(len(candidate), bool)
    bad[:-1] |= weak
    bad[1:] |= weak
    parts = [overhang([r.sequence[: x.before[0]] for r, x in zip(reads, found)], reads, True)]
    edges = np.flatnonzero(np.diff(bad.astype(np.int8))) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(candidate)]):
        parts.append(mode([r.sequence[x.before[a] : x.until[b - 1]] for r, x in zip(reads, found)], reads) if bad[a] else candidate[a:b])
    parts.append(overhang([r.sequence[x.until[-1] :] for r, x in zip(reads, found)], reads, False))
    return "".join(parts)


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 100 + 0.5) / 100


def agreement(candidate: str, reads: list[Read], found: list[Aligned]) -> tuple[float, list[Site]]:
    """The least share of reads that agree with an inner letter, and the sites (of the reversed strand) that have no more."""
    if not candidate:
        return 0.0, []
    n = np.array([r.n for r in reads])
    before, until = np.stack([x.before for x in found]), np.stack([x.until for x in found])
    letters = np.where(until > before, _letters(reads)[np.arange(len(reads))[:, None], before], 0)
    share = _rounded((n @ (letters == np.frombuffer(candidate.encode("latin-1", "replace"), np.uint8))) / n.sum())
    least = float(share[1:-1].min()) if len(share) > 2 else 0.0
    last = np.array([r.last for r in reads])
    kinds = np.unique(letters)
    counts = np.stack([n @ (letters == k) for k in kinds])
    reached = np.stack([np.where(letters == k, last[:, None], -1).max(axis=0) for k in kinds])
    modal = kinds[np.lexsort((reached, -counts), axis=0)[0]]
    edges = np.flatnonzero(np.diff(modal.astype(np.int64))) + 1
    sizes = np.diff(np.concatenate(([0], edges, [len(modal)])))
    runs = np.repeat(sizes, sizes)
    low = np.flatnonzero((share <= least) & (modal > 0))
    return least, [Site(len(candidate) - k, float(share[k]), chr(modal[k]).translate(_COMPLEMENT), int(runs[k])) for k in low.tolist()]


def consensuses(families: list[list[Read]]) -> list[Consensus]:
    """The consensus of each family of distinct reads; families are aligned together, pass by pass."""
    out: list[Consensus | None] = [Consensus(f[0].sequence, 1.0, []) if len(f) == 1 else None for f in families]
    open_ = {k: central(f) for k, f in enumerate(families) if out[k] is None}
    closed: dict[int, str] = {}
    for _ in range(PASSES):
        found = _against(open_, families)
        then = {k: refined(candidate, families[k], found[k]) for k, candidate in open_.items()}
        for k, candidate in open_.items():
            if then[k] == candidate:
                least, sites = agreement(candidate, families[k], found[k])
                out[k] = Consensus(candidate, least, sites)
        open_ = {k: x for k, x in then.items() if out[k] is None}
        closed = dict(open_)
    found = _against(closed, families)
    for k, candidate in closed.items():
        least, sites = agreement(candidate, families[k], found[k])
        out[k] = Consensus(candidate, least, sites)
    return out  # type: ignore[return-value]


def _against(candidates: dict[int, str], families: list[list[Read]]) -> dict[int, list[Aligned]]:
    pairs = [(candidate, r.sequence) for k, candidate in candidates.items() for r in families[k]]
    paths = iter(alignment.seeded_steps(pairs))
    return {k: [Aligned(*alignment.places(next(paths))) for _ in families[k]] for k in candidates}


def primer_cut(sequences: list[str], primer: str) -> list[str]:
    """Sequences without the primer at their start, whether it is there letter by letter (N is any) or has to be aligned."""
    primer = primer.upper()

    def fits(text: str) -> bool:
        return len(text) >= len(primer) and all(p in ("N", c) for p, c in zip(primer, text.upper()))

    out: list[str] = []
    heads = {s[: len(primer) + PRIMER_SLACK] for s in sequences if primer and s and not fits(s)}
    ends = {h: int(alignment.places(path)[1][-1]) for h, path in zip(heads, alignment.steps([(primer, h) for h in heads], scores=PRIMER_SCORES))}
    for s in sequences:
        head = s[: len(primer) + PRIMER_SLACK]
        out.append(s if not primer or not s else s[ends[head] :] if head in ends else s[len(primer) :])
    return out


def reversed_complement(text: str) -> str:
    return text.upper().translate(_COMPLEMENT)[::-1]


_RECORD = "sequence string, agreement double, sites array<struct<position int, agreement float, modal_base string, run_length int>>"
_SITES = pa.list_(pa.struct([("position", pa.int32()), ("agreement", pa.float32()), ("modal_base", pa.string()), ("run_length", pa.int32())]))


def family_consensus(reads: DataFrame, key: list[str], primers: dict[int, str] | None = None, sample: str = "sample_idx") -> DataFrame:
    """key columns, family_size, sequence, agreement, sites: a row for each family of reads (key, sequence, ordinal).

    primers: by sample (a column of the key), the primer cut from the consensus, which is then reversed and complemented;
    without it the consensus stays as it is. Null sequences count as empty; all reads of a family give one row.
    """
    own = reads.select(*key, F.upper(F.coalesce("sequence", F.lit(""))).alias("sequence"), "ordinal")
    rows = own.groupBy(*key, "sequence").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    rows = rows.repartition(*key).sortWithinPartitions(*key, "first")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema) + f", family_size long, {_RECORD}"
    types = [f.dataType for f in rows.select(*key).schema]
    return rows.mapInArrow(_grouped(key, key.index(sample) if primers else -1, primers or {}, types), schema)


def _grouped(key: list[str], sample: int, primers: dict[int, str], types: list):
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(t) for t in types]

    def finished(families: list[tuple[tuple, list[Read]]]) -> pa.RecordBatch:
        found = consensuses([reads for _, reads in families])
        texts = [x.sequence for x in found]
        if sample >= 0:
            for which in {name[sample] for name, _ in families}:
                own = [k for k, (name, _) in enumerate(families) if name[sample] == which]
                for k, text in zip(own, primer_cut([texts[k] for k in own], primers.get(which, ""))):
                    texts[k] = reversed_complement(text)
        columns = [pa.array(c, t) for c, t in zip(zip(*[name for name, _ in families]), kinds)]
        columns += [
            pa.array([sum(r.n for r in reads) for _, reads in families], pa.int64()),
            pa.array(texts, pa.string()),
            pa.array([x.agreement for x in found], pa.float64()),
            pa.array([[s._asdict() for s in x.sites] for x in found], _SITES),
        ]
        return pa.RecordBatch.from_arrays(columns, [*key, "family_size", "sequence", "agreement", "sites"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families: list[tuple[tuple, list[Read]]] = []
        letters = 0
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in key)))
            for name, sequence, n, first, last in zip(names, *(batch.column(c).to_pylist() for c in ("sequence", "n", "first", "last"))):
                if not families or families[-1][0] != name:
                    if letters >= BATCH_LETTERS:
                        yield finished(families)
                        families, letters = [], 0
                    families.append((name, []))
                families[-1][1].append(Read(sequence, n, first, last))
                letters += len(sequence)
        if families:
            yield finished(families)

    return run
