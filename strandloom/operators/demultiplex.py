"""From raw reads to reads of samples: primers in either orientation, the sample's identifier, and the tag behind it.

Each read is trimmed between its group's forward primer and the samples' common adapter, turned so that the identifier
comes first, and given to every sample of the group whose identifier lies in its first bases. The tag is read off the best
path of a profile (identifier, tag letters, what follows, anything) through the start of the read.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import stable_hashes
from .trimming import _MASK, find, reverse_complements

#: Log scores of the profile, how near two scores count as equal, and errors beyond which a tag is rejected.
INSERTION = DELETION = -4.605170185988091
ANY_BASE, MATCH, MISMATCH, EQUAL = -1.3862943611198906, -0.0010005003335835344, -8.006367567650246, 1e-10
MOST_ERRORS, REJECTS, NO_TAG = 4, "REJECTS", "NO_TAG"
#: Bases in which an identifier must start, and bases of a tag's window besides those of the profile.
ID_WINDOW, TAG_HEAD, TAG_SLACK = 10, 6, 2
_DIAGONAL, _DELETION, _INSERTION = 0, 1, 2


class Sample(NamedTuple):
    """cdna_primer: adapter in capitals, identifier in lower case, tag as a run of N, and what follows it."""

    name: str
    cdna_primer: str
    forward: str

    @property
    def identifier(self) -> str:
        found = re.search("[a-z]+", self.cdna_primer)
        return found.group().upper() if found else ""


class Profile(NamedTuple):
    """fixed: letters, or None for a letter of the tag; behind the last one anything may follow."""

    fixed: list[str | None]

    @classmethod
    def of(cls, sample: Sample) -> Profile | None:
        start = re.search("[Nn]", sample.cdna_primer)
        if not start:
            return None
        return cls([*sample.identifier, *(None if c in "Nn" else c.upper() for c in sample.cdna_primer[start.start() :])])


class Gates(NamedTuple):
    """A read passes below the error and between the lengths."""

    error: float = 0.05
    short: int = 2100
    long: int = 4300


class Tags(NamedTuple):
    tag: list[str]
    errors: np.ndarray
    score: np.ndarray


def mean_errors(qualities: list[str]) -> np.ndarray:
    """Mean error probability of Phred+33 texts, summed letter by letter; 1 for an empty one."""
    sizes = np.array([len(q) for q in qualities], int)
    letters = np.zeros((len(qualities), int(sizes.max(initial=0))), np.uint8)
    for row, text in zip(letters, qualities):
        row[: len(text)] = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    chance = 10.0 ** (-np.maximum(np.arange(256) - 33, 0) / 10)
    chance[0] = 0  # behind a text's end
    total = np.zeros(len(qualities))
    for column in letters.T:
        total += chance[column]
    return np.divide(total, sizes, out=np.ones(len(qualities)), where=sizes > 0)


def adapter(samples: list[Sample]) -> str:
    """The letters before the identifier that all samples share."""
    return os.path.commonprefix([re.split("[a-z]", s.cdna_primer)[0] for s in samples])


def groups(samples: list[Sample]) -> list[tuple[str, list[int]]]:
    """(forward primer, samples): samples whose primers are parts of one maximal primer share the first one's search."""
    primers = list(dict.fromkeys(s.forward.upper() for s in samples))
    maximal = [p for p in primers if not any(p != q and p in q for q in primers)]
    members: dict[str, list[int]] = {}
    for k, s in enumerate(samples):
        own = s.forward.upper()
        members.setdefault(min((q for q in maximal if own in q), key=len), []).append(k)
    return [(samples[members[q][0]].forward.upper(), members[q]) for q in maximal if q in members]


def tags(texts: list[str], profile: Profile | None) -> Tags:
    """Each text's tag, the errors on its path and the path's score; of equal scores the diagonal comes before an insertion,
    and this before a deletion. Errors are fixed letters that do not fit, insertions before the end and deletions.
    Without a profile every text is an insertion throughout."""
    return tags_of_all(texts, [0] * len(texts), [profile])


def tags_of_all(texts: list[str], which: list[int], profiles: list[Profile | None]) -> Tags:
    """What tags gives for each text and the profile it has; profiles with their tag in the same place are aligned together.

    Where all fixed letters fit without a gap, no other path comes near: it would need an insertion, a deletion or a mismatch,
    and each costs more than any letter. Only other texts are aligned.
    """
    out = Tags([""] * len(texts), np.zeros(len(texts), int), np.zeros(len(texts)))
    layouts: dict[tuple[bool, ...] | None, list[int]] = {}
    for k, own in enumerate(which):
        profile = profiles[own]
        layouts.setdefault(tuple(x is None for x in profile.fixed) if profile else None, []).append(k)
    for layout, rows in layouts.items():
        fixed = np.zeros((len(layout or ()), len(rows)), np.uint8)
        for own in {which[k] for k in rows}:
            fixed[:, [which[k] == own for k in rows]] = np.array([_MASK[ord(x)] if x else 255 for x in (profiles[own].fixed if profiles[own] else [])], np.uint8)[:, None]
        size, of_tag, open_ = len(fixed), [k for k, x in enumerate(layout or ()) if x], list(range(len(rows)))
        if of_tag:
            heads = np.zeros((len(rows), size), np.uint8)
            for row, k in zip(heads, rows):
                text = texts[k][:size]
                row[: len(text)] = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
            straight = np.array([len(texts[k]) >= size for k in rows], bool)
            straight &= ((_MASK[heads] & fixed.T) > 0)[:, [k for k, x in enumerate(layout) if not x]].all(axis=1)
            letters, score = heads[:, of_tag].tobytes().decode("ascii").upper(), 0.0
            for x in layout:
                score += ANY_BASE if x else MATCH
            for k in np.flatnonzero(straight).tolist():
                out.tag[rows[k]], out.score[rows[k]] = letters[k * len(of_tag) : (k + 1) * len(of_tag)], score
            open_ = np.flatnonzero(~straight).tolist()
        if open_:
            own = [rows[k] for k in open_]
            found = _aligned_tags([texts[k] for k in own], layout, fixed[:, open_])
            out.errors[own], out.score[own] = found.errors, found.score
            for k, tag in zip(own, found.tag):
                out.tag[k] = tag
    return out


def _aligned_tags(texts: list[str], layout: tuple[bool, ...] | None, fixed: np.ndarray) -> Tags:
    """What tags gives, by the whole program. layout: whether a letter belongs to the tag, None without a profile; fixed: the
    masks of the letters, by letter and text."""
    n, profile = len(texts), layout is not None
    sizes = np.array([len(t) for t in texts], int)
    width = int(sizes.max(initial=0))
    raw = np.zeros((n, width + 1), np.uint8)
    for row, text in zip(raw, texts):
        row[1 : len(text) + 1] = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    masks = _MASK[raw]
    columns = np.ascontiguousarray(masks.T)
    rows = len(fixed) + (2 if profile else 1)
    last = rows - 1 if profile else -1
    score = np.zeros((rows, width + 1, n))
    trace = np.full((rows, width + 1, n), _INSERTION, np.uint8)
    score[0] = (np.arange(width + 1) * INSERTION)[:, None]
    for row in range(1, rows):
        score[row, 0], trace[row, 0] = score[row - 1, 0] + (0.0 if row == last else DELETION), _DELETION
        if row == last:
            for at in range(1, width + 1):
                down = score[row - 1, at] > score[row, at - 1] - EQUAL
                score[row, at] = np.where(down, score[row - 1, at], score[row, at - 1])
                trace[row, at] = np.where(down, _DELETION, _INSERTION)
            continue
        wanted = None if layout[row - 1] else np.ascontiguousarray(fixed[row - 1])
        for at in range(1, width + 1):
            emission = ANY_BASE if wanted is None else np.where(columns[at] & wanted, MATCH, MISMATCH)
            diagonal, inserted, deleted = score[row - 1, at - 1] + emission, score[row, at - 1] + INSERTION, score[row - 1, at] + DELETION
            straight = (diagonal > deleted - EQUAL) & (diagonal > inserted - EQUAL)
            across = inserted > deleted - EQUAL
            score[row, at] = np.where(straight, diagonal, np.where(across, inserted, deleted))
            trace[row, at] = np.where(straight, _DIAGONAL, np.where(across, _INSERTION, _DELETION))
    every = np.arange(n)
    total = score[rows - 1, sizes, every]
    # by row of the path: whether the letter before or after it belongs to the tag, and the mask of a fixed letter
    of_tag = np.array([False, *(layout or ()), *([False] if profile else [])])
    next_of_tag = np.append(of_tag[1:], False)
    wanted = np.concatenate((np.zeros((1, n), np.uint8), fixed, np.full((int(profile), n), 255, np.uint8)))
    row, at, errors = np.full(n, rows - 1), sizes.copy(), np.zeros(n, int)
    taken: list[np.ndarray] = []
    while (going := (row > 0) | (at > 0)).any():
        step = np.where(going, trace[row, at, every], 255)
        straight, deleted, inserted = step == _DIAGONAL, step == _DELETION, step == _INSERTION
        errors += straight & ((masks[every, at] & wanted[row, every]) == 0) & ~of_tag[row]
        errors += (deleted | inserted) & (row != last)
        emits = (straight & of_tag[row]) | (inserted & (of_tag[row] | next_of_tag[row]))
        taken.append(np.where(emits, raw[every, at], 0))
        row, at = row - (straight | deleted), at - (straight | inserted)
    letters = np.array(taken, np.uint8).reshape(-1, n)[::-1].T
    found = [x.tobytes().replace(b"\0", b"").decode("ascii").upper() for x in letters] if len(taken) else [""] * n
    return Tags(found, errors, total)


class Pieces(NamedTuple):
    """Inserts between the primers, with their quality; None where neither orientation has both."""

    sequence: list[str | None]
    quality: list[str | None]


def trimmed(reads: list[str], qualities: list[str], forward: str, reverse: str, tolerance: int, window: int, chop: int) -> Pieces:
    """The first orientation counts in which the last hit of each primer leaves something between them."""
    sequence: list[str | None] = [None] * len(reads)
    quality: list[str | None] = [None] * len(reads)
    left_over = list(range(len(reads)))
    for turned in (False, True):
        texts = [reads[k] for k in left_over]
        texts = reverse_complements(texts) if turned else texts
        a = find([t[:window] for t in texts], forward[chop:], tolerance, last=True, starts=False)
        b = find(reverse_complements([t[-window:] for t in texts]), reverse[chop:], tolerance, last=True, starts=False)
        rest = []
        for i, k in enumerate(left_over):
            first, end = int(a.end[i]), len(texts[i]) - int(b.end[i])
            if a.found[i] and b.found[i] and first < end:
                sequence[k], quality[k] = texts[i][first:end], (qualities[k][::-1] if turned else qualities[k])[first:end]
            else:
                rest.append(k)
        left_over = rest
    return Pieces(sequence, quality)


_SCHEMA = "ordinal long, name string, status string, sample_idx int, umi string, tag_errors int, sequence string, quality string, sampling_hash decimal(20,0)"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.decimal128(20, 0)]
_COLUMNS = ["ordinal", "name", "status", "sample_idx", "umi", "tag_errors", "sequence", "quality", "sampling_hash"]


def _left_out(ordinal: list[int], names: list[str], why: list[str]) -> pa.RecordBatch:
    columns = [ordinal, names, why, *([[None] * len(why)] * 6)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _COLUMNS)


def _demultiplexed(samples: list[Sample], gates: Gates, tolerance: int, window: int, chop: int, seed: int):
    ends, reverse = groups(samples), adapter(samples).upper()
    if chop >= min([len(reverse), *(len(f) for f, _ in ends)]):
        raise ValueError("chop leaves nothing of a primer")
    profiles = [Profile.of(s) for s in samples]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ordinal, reads, qualities = (batch.column(c).to_pylist() for c in ("ordinal", "sequence", "quality"))
            reads = [(x or "").upper() for x in reads]
            qualities = [(x or "").ljust(len(r), "!")[: len(r)] for x, r in zip(qualities, reads)]
            errors, sizes = mean_errors(qualities), np.array([len(r) for r in reads], int)
            names = [f"seq{k}|ee={e:.16g}" for k, e in zip(ordinal, errors.tolist())]
            gate = np.select([errors >= gates.error, sizes <= gates.short, sizes >= gates.long], ["quality-reject", "short-reject", "long-reject"], "")
            bad = np.flatnonzero(gate != "").tolist()
            yield _left_out([ordinal[k] for k in bad], [names[k] for k in bad], gate[bad].tolist())
            good = np.flatnonzero(gate == "").tolist()
            ordinal, reads, qualities, names = ([x[k] for k in good] for x in (ordinal, reads, qualities, names))
            primed, assigned = np.zeros(len(reads), bool), np.zeros(len(reads), bool)
            hits: list[tuple[int, list[int], list[str], list[str]]] = []
            for forward, members in ends:
                pieces = trimmed(reads, qualities, forward, reverse, tolerance, window, chop)
                own = [k for k, x in enumerate(pieces.sequence) if x is not None]
                primed[own] = True
                turned = reverse_complements([pieces.sequence[k] or "" for k in own])
                for which in members:
                    identifier = samples[which].identifier
                    if not identifier:
                        continue
                    hit = find([t[:ID_WINDOW] for t in turned], identifier, 0)
                    mine = np.flatnonzero(hit.found).tolist()
                    if not mine:
                        continue
                    rows = [own[i] for i in mine]
                    texts = [turned[i][hit.start[i] :] for i in mine]
                    phred = [(pieces.quality[own[i]] or "")[::-1][hit.start[i] :] for i in mine]
                    assigned[rows] = True
                    hits.append((which, rows, texts, phred))
            behind = [len(p.fixed) + 1 - len(s.identifier) if p else 0 for p, s in zip(profiles, samples)]
            windows = [t[: TAG_HEAD + behind[which] + TAG_SLACK] for which, _, texts, _ in hits for t in texts]
            found, done = tags_of_all(windows, [which for which, rows, _, _ in hits for _ in rows], profiles), 0
            for which, rows, texts, phred in hits:
                errors, tag = found.errors[done : done + len(rows)], found.tag[done : done + len(rows)]
                done += len(rows)
                wrong = (errors > MOST_ERRORS).tolist()
                umi = [REJECTS if b else t or NO_TAG for t, b in zip(tag, wrong)]
                label = [names[k] for k in rows]
                hashes = [Decimal(x) for x in stable_hashes(label, umi, seed ^ which).tolist()]
                status = ["BPB-reject" if b else "assigned" for b in wrong]
                columns = [[ordinal[k] for k in rows], label, status, [which] * len(rows), umi, errors.tolist(), texts, phred, hashes]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _COLUMNS)
            lost = np.flatnonzero(~assigned).tolist()
            yield _left_out([ordinal[k] for k in lost], [names[k] for k in lost], ["id-reject" if primed[k] else "primer-reject" for k in lost])

    return run


def demultiplexed(reads: DataFrame, samples: list[Sample], gates: Gates = Gates(), tolerance: int = 1, window: int = 200, chop: int = 0, seed: int = 0) -> DataFrame:
    """ordinal, name, status, sample_idx, umi, tag_errors, sequence, quality, sampling_hash of reads (ordinal, sequence, quality).

    A read gives a row for each sample it is assigned to (status assigned, or BPB-reject where its tag has too many errors
    and is called REJECTS), or one row with what it failed first: quality-reject, short-reject, long-reject, primer-reject
    or id-reject. Sequences start with the identifier. Null sequences count as empty, and qualities have the length of their
    read (missing letters are the worst). sampling_hash: an unsigned 64-bit hash of name and tag, for down-sampling.
    """
    own = reads.select(F.col("ordinal").cast("long").alias("ordinal"), "sequence", "quality")
    return own.mapInArrow(_demultiplexed(samples, gates, tolerance, window, chop, seed), _SCHEMA)


def stage_counts(reads: DataFrame, samples: list[Sample], gates: Gates = Gates(), tolerance: int = 1, window: int = 200, chop: int = 0) -> DataFrame:
    """What status_counts gives for the demultiplexed reads; tasks count, so the reads themselves are not handed back."""
    assign = _demultiplexed(samples, gates, tolerance, window, chop, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int | None]] = Counter()
        for batch in assign(batches):
            seen.update(zip(batch.column("status").to_pylist(), batch.column("sample_idx").to_pylist()))
        status, sample, n = [s for s, _ in seen], [k for _, k in seen], list(seen.values())
        yield pa.RecordBatch.from_arrays([pa.array(status, pa.string()), pa.array(sample, pa.int32()), pa.array(n, pa.int64())], ["status", "sample_idx", "n"])

    own = reads.select(F.col("ordinal").cast("long").alias("ordinal"), "sequence", "quality")
    return own.mapInArrow(run, "status string, sample_idx int, n long").groupBy("status", "sample_idx").agg(F.sum("n").alias("n"))


def status_counts(rows: DataFrame) -> DataFrame:
    """status, sample_idx, n: how many reads each stage kept and lost."""
    return rows.groupBy("status", "sample_idx").agg(F.count("*").alias("n"))


def downsampled(rows: DataFrame, most: int) -> DataFrame:
    """Assigned rows of which a sample with more than `most` keeps those whose hash lies in the lowest share most / n."""
    seen = rows.where("sample_idx IS NOT NULL").groupBy("sample_idx").agg(F.count("*").alias("n"))
    limit = F.expr(f"CAST(18446744073709551615 AS DECIMAL(20,0)) * CAST({most} AS DECIMAL(18,0))")
    cut = seen.where(F.col("n") > most).select("sample_idx", F.floor(limit / F.col("n").cast("decimal(10,0)")).alias("cutoff"))
    joined = rows.join(F.broadcast(cut), "sample_idx", "left")  # a row for each sample
    return joined.where(F.col("cutoff").isNull() | (F.col("sampling_hash") <= F.col("cutoff"))).select(*rows.columns)
