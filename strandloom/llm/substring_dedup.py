"""Substring dedup: repeated-phrase automata over words.

A passage that recurs is at least WINDOW words long. Two texts that share such a window share its anchor, the phrase of
PHRASE words that hashes lowest in it (as in winnowing), so anchors, a handful per hundred words, find what may recur:

1. Every text gives its anchors. Those that occur in several texts are the recurring phrases.
2. Recurring phrases are dealt out to shards of SHARD_PHRASES, or fewer where their documents would fill more than a block, by
   the document in which they first occur, so that those of one passage stay together. A document goes to the shards of its phrases, and to no other, as it can hold nothing of them;
   documents of a shard are dealt out in blocks. A block's task compiles the shard's phrases, taken from the texts where they
   first occur, into an Aho-Corasick automaton over words, and streams its documents through it, which locates every
   occurrence. Windows whose anchor lies at a located place are the candidates.
3. Candidates are confirmed by two independent 64-bit hashes of all their words: a window goes where it also starts in a
   document with a smaller doc_id. All places of a window are in one shard, that of its anchor, so a block's task settles
   what its own documents repeat and returns runs of starts. Where a shard has several blocks, the first document of each
   window in each block is compared over the blocks.

Texts equal word for word are one class; only its first document goes through the steps, as all others repeat it.

Defined cases: null and empty texts have no words; shorter texts than a window are kept whole; rows that share a
doc_id do not repeat one another, and each keeps its own words; a row with a null doc_id is kept whole and repeats nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Tables, joined_on, small_side
from .words import slices, window_hashes, words_of

WINDOW = 50
#: About half a window: texts that share so much mostly share a window, while shorter phrases recur ever more often as the corpus grows.
PHRASE = 24
SYMBOLS = 4
SHARD_PHRASES = 10_000
#: Words of the documents that one automaton meets; more of a shard's documents go to other tasks with the same automaton.
BLOCK_WORDS = 2_000_000


def _running_minimum(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values, by doubling."""
    out, span = x, 1
    while span * 2 <= n:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = n - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _digest(text: pa.StringScalar) -> str:
    """SHA-256 of a text's words, joined by one space."""
    return hashlib.sha256(b" ".join(bytes(text.as_buffer()).split()) if text.is_valid else b"").hexdigest()


def _key(digest: str) -> int:
    return int(digest[:15], 16)


def _scanned(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            for a, b in slices(texts):
                words = words_of(texts.slice(a, b - a))
                low = _running_minimum(window_hashes(words.hashes, phrase), window - phrase + 1) if len(words.hashes) >= window else None
                n, digests, anchors = np.diff(words.offsets), [], []
                digests += map(_digest, texts.slice(a, b - a))
                for first, end in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
                    found = np.unique(low[first : end - window + 1]) if end - first >= window else np.zeros(0, np.uint64)
                    anchors.append(found.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(anchors, pa.list_(pa.int64()))],
                    ["doc_id", "n_words", "digest", "anchors"],
                )

    return run


def _symbols(hashes: np.ndarray) -> str:
    """Each word as SYMBOLS characters, 4 bits of its hash in each; every place in a word has characters of its own, so
    that matches start and end with words. Few characters keep the automaton's steps short."""
    shifts = np.arange(64 - 4, 64 - 4 * (SYMBOLS + 1), -4, dtype=np.uint64)
    codes = (hashes[:, None] >> shifts) & np.uint64(15)
    return (codes.astype(np.uint8) + np.arange(SYMBOLS, dtype=np.uint8) * 16 + 48).tobytes().decode("latin-1")


class PhraseAutomaton:
    """Phrases given as symbols and hashes, located in texts given as symbols."""

    def __init__(self, phrase: int):
        import ahocorasick

        self.phrase, self.hashes, self.ready = phrase, [], False
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)

    def add(self, symbols: str, value: int) -> None:
        if symbols not in self.automaton:
            self.automaton.add_word(symbols, len(self.hashes))
            self.hashes.append(value)

    def located(self, symbols: str) -> tuple[np.ndarray, np.ndarray]:
        """At which words phrases start, and their hashes."""
        if not self.ready:
            self.automaton.make_automaton()
            self.table, self.ready = np.array(self.hashes, np.uint64), True
        found = np.array(list(self.automaton.iter(symbols)) if self.hashes else [], np.int64).reshape(-1, 2)
        return (found[:, 0] + 1) // SYMBOLS - self.phrase, self.table[found[:, 1]]


def _phrase_rows(phrase: int):
    """(shard, symbols, hashes) of the phrases of each text whose hashes it was given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = batch.column("text"), batch.column("phrases")
            symbols, hashes = [], []
            for a, b in slices(texts):
                words = words_of(texts.slice(a, b - a))
                grams = window_hashes(words.hashes, phrase)
                for k, (first, end) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()), a):
                    own = grams[first : max(first, end - phrase + 1)]
                    found, at = np.unique(own, return_index=True)
                    some = np.isin(found, wanted[k].values.to_numpy().view(np.uint64))
                    symbols.append([_symbols(words.hashes[first + p : first + p + phrase]) for p in at[some].tolist()])
                    hashes.append(found[some].view(np.int64))
            arrays = [batch.column("shard"), pa.array(symbols, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["shard", "symbols", "hashes"])

    return run


class Candidates:
    """Candidate windows of one block."""

    def __init__(self) -> None:
        self.columns: list[list[np.ndarray]] = [[], [], [], [], []]

    def add(self, h1: np.ndarray, h2: np.ndarray, doc_id: int, key: int, at: np.ndarray) -> None:
        for column, value in zip(self.columns, (h1, h2, np.full(len(at), doc_id), np.full(len(at), key), at)):
            column.append(value)

    def settled(self, alone: bool) -> pa.RecordBatch:
        """Runs of n starts that go, as an earlier document of the block has the same windows (h1 and h2 null). Unless
        the block is alone in its shard also each window of a document that is the first to have it, with its hashes."""
        h1, h2, doc_id, key, at = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in self.columns)
        order = np.lexsort((doc_id, h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        least = np.zeros(len(order), np.int64)
        least[order] = doc_id[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
        gone, open_ = np.flatnonzero(doc_id > least), np.flatnonzero((doc_id == least) & (not alone))
        gone = gone[np.lexsort((at[gone], key[gone], doc_id[gone]))]
        fresh = np.ones(len(gone), bool)
        x, y = gone[1:], gone[:-1]
        fresh[1:] = (doc_id[x] != doc_id[y]) | (key[x] != key[y]) | (at[x] > at[y] + 1)
        heads = gone[fresh]
        lasts = at[gone[np.append(fresh[1:], True)]] if len(gone) else at[gone]
        none = pa.nulls(len(heads), pa.int64())
        columns = [pa.concat_arrays([none, pa.array(h[open_].astype(np.int64), pa.int64())]) for h in (h1, h2)]
        columns += [pa.array(np.concatenate([c[heads], c[open_]]), pa.int64()) for c in (doc_id, key, at)]
        columns.append(pa.array(np.concatenate([lasts - at[heads] + 1, np.ones(len(open_), np.int64)]), pa.int64()))
        return pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc_id", "key", "at", "n"])


def _located(window: int, phrase: int):
    """Settled candidates of each block: windows whose lowest phrase the automaton locates.

    Rows are sorted by (shard, block); in each block those with phrases to compile come before the documents to stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton, found, alone = None, PhraseAutomaton(phrase), Candidates(), True
        for batch in batches:
            texts, ids, symbols, hashed = batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("symbols"), batch.column("hashes")
            places = list(zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), batch.column("blocks").to_pylist()))
            for a, b in slices(texts):
                words, more = words_of(texts.slice(a, b - a)), words_of(texts.slice(a, b - a), which=1)
                grams = window_hashes(words.hashes, phrase)
                low = _running_minimum(grams, window - phrase + 1) if len(words.hashes) >= window else grams[:0]
                h1, h2 = window_hashes(words.hashes, window), window_hashes(more.hashes, window, which=1)
                for k, (first, end) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()), a):
                    if places[k] != now:
                        yield found.settled(alone)
                        now, automaton, found, alone = places[k], PhraseAutomaton(phrase), Candidates(), places[k][2] == 1
                    if symbols[k].is_valid:
                        for value, own in zip(symbols[k].as_py(), hashed[k].values.to_numpy().view(np.uint64).tolist()):
                            automaton.add(value, own)
                    if end - first < window:
                        continue
                    starts, hashes = automaton.located(_symbols(words.hashes[first:end]))
                    starts = first + starts[grams[first + starts] == hashes]
                    if not len(starts):
                        continue
                    # the lowest phrase among the located ones of each window, against the lowest of all
                    there = np.full(end - first - phrase + 1, np.iinfo(np.uint64).max)
                    there[starts - first] = grams[starts]
                    at = np.flatnonzero(_running_minimum(there, window - phrase + 1) == low[first : end - window + 1])
                    found.add(h1[first + at].view(np.int64), h2[first + at].view(np.int64), ids[k], _key(_digest(texts[k])), at)
        yield found.settled(alone)

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, removed, digests, texts = [], [], [], []
            for i, (text, starts, key) in enumerate(zip(batch.column("text"), batch.column("starts"), batch.column("key").to_pylist())):
                if not text.is_valid or _key(_digest(text)) != key:
                    continue
                own.append(i)
                words = bytes(text.as_buffer()).split()
                gone = np.zeros(len(words) + 1, np.int64)
                at, n = (starts.values.field(f).to_numpy() for f in ("at", "n"))
                np.add.at(gone, at, 1)
                np.add.at(gone, at + n - 1 + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode())
            batch = batch.take(pa.array(own, pa.int64()))
            arrays = [batch.column("doc_id"), batch.column("key"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n_removed", "kept_sha256", "kept"])

    return run


def occurrences(own: DataFrame, anchors: DataFrame, shared: DataFrame, window: int, phrase: int, tables: Tables) -> DataFrame:
    """What blocks of documents (doc_id, text) settle of the windows anchored at a recurring phrase (anchor, first, n)."""
    met = joined_on(anchors, shared.select("anchor", "first", "n"), ["anchor"], tables)
    met = tables.written(met.groupBy("doc_id", "first").agg(F.max("n_words").alias("n_words")), "met")
    words = met.groupBy("doc_id").agg(F.max("n_words").alias("n")).agg(F.sum("n")).first()[0] or 0
    # twice as many shards as blocks would be needed, so that only a passage that very many texts share needs several blocks
    shards = max(1, -(-shared.count() // SHARD_PHRASES), -(-2 * words // BLOCK_WORDS))
    shard = F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int").alias("shard")
    compiled = shared.groupBy(shard, F.col("first").alias("doc_id")).agg(F.collect_list("anchor").alias("phrases"))
    routes = tables.written(met.groupBy("doc_id", shard).agg(F.max("n_words").alias("n_words")), "routes")
    tables.drop(anchors, met)
    sizes = routes.groupBy("shard").agg(F.ceil(F.sum("n_words") / F.lit(BLOCK_WORDS)).cast("int").alias("blocks"))
    places = routes.join(sizes, "shard").join(compiled, ["doc_id", "shard"], "left")
    places = places.groupBy("doc_id").agg(F.collect_list(F.struct("shard", "blocks", "phrases")).alias("places"))
    places = tables.written(places, "places")
    # texts are shuffled once, and only those that hold a recurring phrase
    routed = own.join(small_side(places.select("doc_id")), "doc_id", "left_semi").join(places, "doc_id")
    routed = tables.written(routed, "routed")
    each = routed.select("doc_id", "text", F.explode("places").alias("at")).select("doc_id", "text", "at.*")
    rows = each.where("phrases is not null").select("text", "shard", "phrases").mapInArrow(_phrase_rows(phrase), "shard int, symbols array<string>, hashes array<long>")
    rows = tables.written(rows, "compiled")
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    sources = rows.join(sizes, "shard").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "shard", "blocks", blocks, "symbols", "hashes")
    none = [F.lit(None).cast("array<string>").alias("symbols"), F.lit(None).cast("array<bigint>").alias("hashes")]
    texts = each.select("doc_id", "text", "shard", "blocks", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), *none)
    both = sources.unionByName(texts).repartition("shard", "block").sortWithinPartitions("shard", "block", F.col("doc_id").isNotNull())
    return both.mapInArrow(_located(window, phrase), "h1 long, h2 long, doc_id long, key long, at long, n long")


def deduplicated(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with_text: also kept, what is left where something goes."""
    tables = Tables(docs.sparkSession)
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = tables.written(own.mapInArrow(_scanned(window, phrase), "doc_id long, n_words long, digest string, anchors array<long>"), "scanned")
    long = rows.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
    classes = tables.written(long.groupBy("digest").agg(F.min("doc_id").alias("first")), "classes")
    firsts = long.join(classes.select("digest", F.col("first").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    anchors = tables.written(firsts.select("doc_id", "n_words", F.explode("anchors").alias("anchor")), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    shared = tables.written(shared.where("first <> last").drop("last"), "phrases")
    windows = tables.written(occurrences(own, anchors, shared, window, phrase, tables), "windows")
    tables.keep(rows, classes, windows)
    settled, windows = windows.where("h1 is null").select("doc_id", "key", "at", "n"), windows.where("h1 is not null").drop("n")
    first = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    first = tables.written(first.where("first <> last").drop("last"), "confirmed")
    later = joined_on(windows, first, ["h1", "h2"], tables).where("doc_id > first").select("doc_id", "key", "at", F.lit(1).cast("long").alias("n"))
    starts = settled.unionByName(later).groupBy("doc_id", "key").agg(F.collect_list(F.struct("at", "n")).alias("starts"))
    starts = tables.written(starts, "starts")
    # texts from which nothing goes are not shuffled
    cut = own.join(small_side(starts.select("doc_id").distinct()), "doc_id", "left_semi")
    cut = cut.join(starts, "doc_id").mapInArrow(_kept(window), "doc_id long, key long, n_removed long, kept_sha256 string, kept string")
    if not with_text:
        cut = cut.drop("kept")
    cut = tables.written(cut.dropDuplicates(["doc_id", "key"]), "cut")
    tables.keep(rows, classes, cut)
    copies = rows.join(classes, "digest", "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window), F.lit(False))
    key = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    out = copies.withColumn("copy", copy).withColumn("key", key).drop("anchors", "first")
    out = out.join(cut.withColumnRenamed("kept_sha256", "cut_sha256").withColumnRenamed("n_removed", "cut_words"), ["doc_id", "key"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    columns = [
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("cut_sha256", "digest")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*columns)
