"""Spelling variant grouping: Aho-Corasick automata over the two halves of every word.

Words that differ by one edit agree in one of their halves: the edit lies in the other one. So

1. words and their counts are one aggregation over all texts;
2. the words are dealt into shards; a task compiles the halves of a shard's words, each with the separator that it touches,
   into one automaton and scans all words of a block through it. The separator pins a half to the start or the end of the
   scanned word. Hits whose word lengths differ by more than one are left;
3. a hit leads to those words of the half that also agree in a quarter on the other side (one of the other half's own halves
   must be whole), and these are verified letter by letter;
4. each word takes its most frequent near word, if that is ten times as frequent, and forms are followed by pointer jumping.

Every (shard, block) gives at most one row a word, so groups of words with a common half are never sent as pairs. A shard has
SHARD_WORDS words on average and a block BLOCK_WORDS, whatever the size of the vocabulary.

Defined cases: null and empty texts have no words; a row with a null doc_id counts, but none of its letters is deleted;
repeated rows count once each; words of any length are compared whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Tables
from .words import mixed, powers

MIN_LENGTH, MIN_COUNT, TIMES, DELETED = 7, 2, 10, 31
SHARD_WORDS, BLOCK_WORDS = 250_000, 1_000_000
#: Shards at least, so that small vocabularies do not go to one task.
SHARDS = 8
CHUNK_WORDS = 20_000
#: Pairs that are verified at once.
PAIRS = 100_000
#: Letters that fit in a row of the matrices compared; longer words are compared one by one.
WIDTH = 32
_SEPARATOR = "\n"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of all texts that occur MIN_COUNT times or more."""
    runs = F.explode(F.regexp_extract_all(f"`{text}`", F.lit(f"([A-Za-zÀ-ÿ]{{{MIN_LENGTH},}})"))).alias("run")
    rows = docs.select(F.col(f"`{doc_id}`").cast("string").alias("id"), runs).withColumn("run", F.translate("run", _UPPER, _LOWER))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DELETED == 0, shorter).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


class Lexicon:
    """Words, in any order, as one text with separators around and between them, and hashes of their parts."""

    def __init__(self, joined: str):
        self.text = f"{_SEPARATOR}{joined}{_SEPARATOR}"
        self.letters = np.frombuffer(self.text.encode("latin-1"), np.uint8)
        cuts = np.flatnonzero(self.letters == 10)
        self.starts, self.ends = cuts[:-1] + 1, cuts[1:]
        self.lengths = self.ends - self.starts
        up, self.down = powers(len(self.letters))
        self.sums = np.zeros(len(self.letters) + 1, np.uint64)
        np.cumsum((self.letters.astype(np.uint64) + np.uint64(1)) * up[: len(self.letters)], out=self.sums[1:])
        at = self.starts[:, None] + np.arange(WIDTH)
        inside = np.arange(WIDTH) < self.lengths[:, None]
        self.rows = np.where(inside, self.letters[np.minimum(at, len(self.letters) - 1)], 0).astype(np.uint8)

    def part(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the letters first:end; equal letters have equal hashes wherever they stand."""
        return (self.sums[end] - self.sums[first]) * self.down[first]

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]


def _key(half: np.ndarray, length: np.ndarray, quarter: np.ndarray, which: int) -> np.ndarray:
    return mixed((half.astype(np.uint64) * np.uint64(1 << 20) + length.astype(np.uint64) * np.uint64(4) + np.uint64(which)) * np.uint64(0x9E3779B97F4A7C15) + quarter)


def _quarters(words: Lexicon, own: np.ndarray, half: np.ndarray, length: np.ndarray, front: bool) -> np.ndarray:
    """Two keys for each of some words `own` of which a half agrees with a word of some length: the half with the first
    and with the last part of what is left of the word."""
    size = length // 2 if front else length - length // 2
    first, end = words.starts[own] + np.where(front, size, 0), words.ends[own] - np.where(front, 0, size)
    rest = length - size
    low, high = rest // 2, rest - rest // 2
    which = 0 if front else 2
    return np.stack((_key(half, length, words.part(first, first + low), which), _key(half, length, words.part(end - high, end), which + 1)))


class HalvesAutomaton:
    """The halves of some words in an Aho-Corasick automaton, and the words behind each half."""

    def __init__(self, words: Lexicon):
        import ahocorasick

        self.words, self.automaton = words, ahocorasick.Automaton(ahocorasick.STORE_INTS)
        ids: dict[str, int] = {}
        middle = words.starts + words.lengths // 2
        halves = [
            np.array([ids.setdefault(words.text[a:b], len(ids)) for a, b in zip(first.tolist(), end.tolist())], np.int64)
            for first, end in ((words.starts - 1, middle), (middle, words.ends + 1))
        ]
        for half, i in ids.items():
            self.automaton.add_word(half, i)
        if ids:
            self.automaton.make_automaton()
        self.size = np.array([len(half) - 1 for half in ids], np.int64)
        self.front = np.array([half[0] == _SEPARATOR for half in ids], bool)
        own = np.arange(len(words.starts))
        keys = np.concatenate([_quarters(words, own, half, words.lengths, front) for half, front in zip(halves, (True, False))]).ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], np.tile(own, 4)[order]

    def hits(self, words: Lexicon) -> tuple[np.ndarray, np.ndarray]:
        """(word, half): the halves that each word starts or ends with."""
        found = list(self.automaton.iter(words.text)) if len(self.size) else []
        at, half = np.array(found, np.int64).reshape(-1, 2).T
        # A front half ends inside its word, a back half on the separator behind it.
        return np.searchsorted(words.ends, at), half

    def near(self, words: Lexicon) -> tuple[np.ndarray, np.ndarray]:
        """All (word, own word) that differ by exactly one inserted, deleted or replaced letter."""
        word, half = self.hits(words)
        asked, keys = [], []
        for front in (True, False):
            for more in (0, 1):
                mine = self.front[half] == front
                v, k = word[mine], half[mine]
                length = 2 * self.size[k] + (more if front else -more)
                fits = np.abs(length - words.lengths[v]) <= 1
                both = _quarters(words, v[fits], k[fits], length[fits], front)
                asked += [v[fits], v[fits]]
                keys += [both[0], both[1]]
        v, key = np.concatenate(asked), np.concatenate(keys)
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        some = high > low
        v, low, n = v[some], low[some], (high - low)[some]
        pairs, done = [], 0
        total = np.concatenate(([0], np.cumsum(n)))
        while done < total[-1]:
            until = min(done + PAIRS, int(total[-1]))
            places = np.arange(done, until)
            row = np.searchsorted(total, places, side="right") - 1
            u, w = self.owners[low[row] + places - total[row]], v[row]
            good = self._one_edit(words, w, u)
            pairs.append(np.unique(w[good] * len(self.words.starts) + u[good]))
            done = until
        every = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return every // max(1, len(self.words.starts)), every % max(1, len(self.words.starts))

    def _one_edit(self, words: Lexicon, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        m, n = words.lengths[v], self.words.lengths[u]
        x, y = words.rows[v], self.words.rows[u]
        differs = x != y
        out = (m == n) & (differs.sum(1) == 1)
        first = np.where(differs.any(1), differs.argmax(1), WIDTH)[:, None]
        behind = np.arange(WIDTH - 1) >= first
        out |= (m == n + 1) & ~((x[:, 1:] != y[:, :-1]) & behind).any(1)
        out |= (n == m + 1) & ~((y[:, 1:] != x[:, :-1]) & behind).any(1)
        for i in np.flatnonzero(np.maximum(m, n) > WIDTH).tolist():
            out[i] = one_edit(words.word(v[i]), self.words.word(u[i]))
        return out


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[same + 1 :] == b[same + (len(a) == len(b)) :]


def _joined(words: pa.ListScalar) -> str:
    return pc.binary_join(pa.array([words.as_py()], pa.list_(pa.string())), _SEPARATOR)[0].as_py()


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, best, best_n of the block's words that have near words in the shard."""
    now, automaton, counts = None, None, None
    for batch in batches:
        for k in range(batch.num_rows):
            shard = batch.column("shard")[k].as_py()
            if shard != now:
                own = batch.column("own")[k].as_py()
                own.sort(key=lambda x: x["word"])
                automaton = HalvesAutomaton(Lexicon(_SEPARATOR.join(x["word"] for x in own)))
                counts, now = np.array([x["n"] for x in own], np.int64), shard
            block = batch.column("words")[k].values
            for first in range(0, len(block), CHUNK_WORDS):
                words = Lexicon(_SEPARATOR.join(block.slice(first, CHUNK_WORDS).to_pylist()))
                v, u = automaton.near(words)
                if not len(v):
                    continue
                order = np.lexsort((u, -counts[u], v))  # the shard's words are sorted, so of equal counts the smallest word is first
                v, u = v[order], u[order]
                heads = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
                best = u[heads]
                arrays = [
                    pa.array([words.word(i) for i in v[heads].tolist()], pa.string()),
                    pa.array(np.diff(np.append(heads, len(v))), pa.int64()),
                    pa.array([automaton.words.word(i) for i in best.tolist()], pa.string()),
                    pa.array(counts[best], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["word", "n_near", "best", "best_n"])


def near_words(words: DataFrame, tables: Tables, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, n_near, best, best_n: of each word (word, n) that has near words, how many, and the most frequent one (ties: the
    smallest)."""
    total = words.count()
    shards, blocks = max(SHARDS, -(-total // shard_words)), max(1, -(-total // block_words))
    dealt: Column = F.xxhash64("word")
    own = words.groupBy(F.pmod(dealt, F.lit(shards)).cast("int").alias("shard")).agg(F.collect_list(F.struct("word", "n")).alias("own"))
    scan = words.groupBy(F.pmod(F.shiftrightunsigned(dealt, 32), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list("word").alias("words"))
    own = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    scan = scan.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    both = own.repartition(shards * blocks, "shard", "block").join(scan.repartition(shards * blocks, "shard", "block"), ["shard", "block"])
    parts = tables.written(both.select("shard", "own", "words").mapInArrow(_scanned, "word string, n_near long, best string, best_n long"), "near")
    first = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best"))).alias("first")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", F.col("first.best"), (-F.col("first.k")).alias("best_n"))


def rooted(forms: DataFrame, tables: Tables) -> DataFrame:
    """word, root of each (word, form): the last form, following forms from word to word.

    Counts grow tenfold with each form, so chains are short and a few rounds of pointer jumping end it.
    """
    now = tables.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = tables.written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        tables.drop(now)
        if not then.where("moved").limit(1).count():
            return then.select("word", "root")
        now = then


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts."""
    tables = Tables(docs.sparkSession)
    words = tables.written(vocabulary(docs, doc_id, text), "words")
    near = near_words(words, tables, shard_words, block_words)
    known = tables.written(words.join(near, "word", "left"), "known")
    frequent = F.col("best_n") >= TIMES * F.col("n")
    forms = known.select("word", F.when(frequent, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best_n")).alias("form_n"))
    roots = rooted(forms.where("form IS NOT NULL"), tables)
    out = forms.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
