"""Near-duplicate detection by MinHash, with odd sketches.

A document's set is its distinct five-word shingles. ``SAMPLES`` MinHash samples are taken of it;
the first BANDS * ROWS make band keys, and all are folded into an odd sketch: a bitmap in which each
sample flips one bit. The population count of the exclusive-or of two sketches estimates a high
similarity closely. The steps:

1. Exact copies of the word sequence, by its SHA-256 as a content address, are one row from here on, the one of least doc_id.
2. Rows that share a band key are candidates. Within a bucket the sketches are compared, from one
   row on to those not reached yet, and rows reached from one another hang on the least of them, so
   a bucket of n rows gives at most n - 1 candidate links.
3. Connected candidates form clusters. Within a cluster the full sets are compared, again from one
   row on to those not reached yet, through a table of shingles; a row is reached at
   100 * intersection >= similarity * union. A candidate link alone is never believed. What is reached
   hangs on its least row again, so a cluster that one task compared needs no further round.
4. Documents connected by confirmed links are one component.

Buckets and clusters of more than ``BLOCK`` rows (or ``HEAVY`` shingles) are dealt in blocks: each pair of blocks is one
task's group, so no group is unbounded and no pair is left out.

``similarity`` is in hundredths; the pipeline's stage asks for 80. A pair at 0.80 misses all bands with
probability (1 - 0.80^4)^24 = 3e-6, one at 0.85 with 2e-8; the sketch lets pass what it estimates at
six deviations below the similarity or more (0.54 for 0.80, 0.62 for 0.85).

Defined cases: null and blank texts have empty sets and stand alone; under five words the whole
sequence is the one shingle; very long texts are compared whole; null doc_ids are numbered after all others and have a null
component_id when alone; repeated rows (equal ids) are copies like any other, of which one is kept;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.common import is_table, spread_join, stored
from loomrec.llm.components import connected
from loomrec.session import write_through

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHINGLE, SAMPLES, BANDS, ROWS, SKETCH_BITS = 5, 128, 24, 4, 256
SIMILAR, BLOCK, HEAVY = 85, 3000, 4_000_000
#: Words of which a worker remembers the hash.
REMEMBERED = 500_000

_seeds = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _seeds.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _seeds.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
POWERS = _seeds.integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_word_hashes: dict[str, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text in order, A-Z lower-cased."""
    import xxhash

    if not text:
        return np.empty(0, np.uint64)
    out = []
    for word in WORD.findall(text.translate(LOWER)):
        h = _word_hashes.get(word)
        if h is None:
            if len(_word_hashes) >= REMEMBERED:
                _word_hashes.clear()
            h = _word_hashes[word] = xxhash.xxh3_64_intdigest(word)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """The distinct shingle hashes of a word sequence, sorted."""
    n = len(words)
    if n == 0:
        return words
    if n < SHINGLE:
        total = np.array([n], dtype=np.uint64) * POWERS[SHINGLE]
        for k in range(n):
            total += words[k : k + 1] * POWERS[k]
        return _mixed(total)
    total = np.zeros(n - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        total += words[k : n - SHINGLE + 1 + k] * POWERS[k]
    return np.unique(_mixed(total))


def min_hashes(items: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for begin in range(0, len(items), 1024):
        part = items[begin : begin + 1024]
        np.minimum(least, (FACTORS[:, None] * part[None, :] + OFFSETS[:, None]).min(axis=1), out=least)
    return least


def odd_sketch(least: np.ndarray) -> bytes:
    """Each sample, with its number, flips one bit."""
    bits = _mixed(least + np.arange(SAMPLES, dtype=np.uint64) * POWERS[0]) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64) * POWERS[SHINGLE]
    for k in range(ROWS):
        total = total + rows[:, k] * POWERS[k]
    return _mixed(total).view(np.int64)


def estimate(flipped: np.ndarray) -> np.ndarray:
    """Similarity from the number of bits in which two sketches differ."""
    share = np.minimum(2.0 * flipped / SKETCH_BITS, 1 - 1e-9)
    return 1.0 + SKETCH_BITS / (4.0 * SAMPLES) * np.log(1.0 - share)


def let_pass(similarity: int) -> float:
    """The least estimate of a candidate: six deviations or more below a similarity of 80 to 100 hundredths."""
    if not 80 <= similarity <= 100:
        raise ValueError(f"a similarity of {similarity}: the bands are made for 80 to 100")
    return 0.62 - 1.6 * (85 - similarity) / 100


SIGNED = "loc struct<file:string,at:bigint>, doc_id bigint, n_shingles bigint, sequence string, sketch binary, bands array<bigint>"


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            text = text if isinstance(text, str) else ""
            items = shingles(word_hashes(text))
            least = min_hashes(items) if len(items) else None
            address = hashlib.sha256("\n".join(WORD.findall(text.translate(LOWER))).encode("utf-8", "surrogatepass")).hexdigest() if len(items) else None
            rows.append((len(items), address, odd_sketch(least) if len(items) else None, band_keys(least) if len(items) else None))
        yield pd.DataFrame({"loc": batch["loc"], "doc_id": batch["doc_id"].astype("Int64"), "n_shingles": [r[0] for r in rows], "sequence": [r[1] for r in rows], "sketch": [r[2] for r in rows], "bands": [r[3] for r in rows]})


def _sized(rows: DataFrame, group: str, weight: str | None = None) -> DataFrame:
    """Each group of two rows or more with n rows and the blocks it is dealt in, as a scratch table."""
    need = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(weight if weight else F.lit(0)) / HEAVY), F.lit(1))
    return write_through(rows.groupBy(group).agg(need.cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-sizes")


def _blocked(rows: DataFrame, sizes: DataFrame, group: str, name: str, total: int) -> DataFrame:
    """Adds low and high: a group of up to BLOCK rows (and HEAVY of summed weight) is one part; beyond, each row is in one part for each pair of its block with another."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    mine = F.pmod(F.xxhash64(name), "blocks").cast("int")
    joined = spread_join(rows, sizes, group, "n", F.lit(total))
    return joined.select(*rows.columns, mine.alias("mine"), other).select(*rows.columns, F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))


def _by_group(rows: DataFrame, keys: list[str], value: str, links) -> DataFrame:
    """links(rids, values) of every group, as rows a, b. Groups are contiguous in sorted partitions; a task holds one at a time, and one Arrow batch."""
    n_keys = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            whole = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(whole):
                continue
            marks = whole.iloc[:, :n_keys].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1])
            held = whole.iloc[starts[-1] :]
            yield _linked(whole.iloc[: starts[-1]], starts, links)
        if held is not None:
            yield _linked(held, np.array([0, len(held)]), links)

    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "rid", value).mapInPandas(run, "a bigint, b bigint")


def _linked(rows: pd.DataFrame, starts: np.ndarray, links) -> pd.DataFrame:
    rids, values = rows["rid"].to_numpy(), rows.iloc[:, -1].to_numpy()
    found = [links(rids[i:j], values[i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)]
    pairs = [p for group in found for p in group]
    return pd.DataFrame({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}, dtype="int64")


def _stars(rids: np.ndarray, near) -> list[tuple[int, int]]:
    """The least row of those reached from one another, with each other one; near(i, rest) marks which of rest are linked to i."""
    left, links = np.arange(len(rids)), []
    while len(left):
        reached, left, k = [left[0]], left[1:], 0
        while k < len(reached) and len(left):
            hit = near(reached[k], left)
            reached += list(left[hit])
            left = left[~hit]
            k += 1
        first, *others = sorted(int(rids[i]) for i in reached)
        links += [(first, other) for other in others]
    return links


def _candidates(rids: np.ndarray, values: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Rows of one bucket that the sketches let pass, as stars."""
    sketches = np.frombuffer(b"".join(values), dtype=np.uint64).reshape(len(rids), -1)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        return estimate(np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1)) >= least

    return _stars(rids, near)


def _confirmed(rids: np.ndarray, values: np.ndarray, similarity: int) -> list[tuple[int, int]]:
    """Rows of one cluster that similar full sets connect, as stars."""
    sets = [shingles(word_hashes(t)) for t in values]
    sizes = np.array([len(s) for s in sets])
    # The table of shingles: for each, the rows that hold it.
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    items, holders = flat[order], owner[order]

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        begin, end = np.searchsorted(items, sets[i], "left"), np.searchsorted(items, sets[i], "right")
        n = end - begin
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(holders[at], minlength=len(sets))[rest]
        return 100 * common >= similarity * (sizes[rest] + sizes[i] - common)

    return _stars(rids, near)


def _components(table: DataFrame, similarity: int) -> DataFrame:
    """loc, doc_id, n_shingles, component_id, kept for every row of ``table`` (loc, row, as stored() gives it), as a scratch table."""
    read = table.select("loc", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    signed = write_through(read.mapInPandas(_sign, SIGNED).withColumn("rid", F.monotonically_increasing_id()), "near-signed")
    # Of copies the first stands for all; an empty set is linked with nothing.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    some = signed.where("sequence is not null")
    leader = F.min_by(F.struct("loc", "n_shingles", "sketch", "bands"), rank).alias("leader")
    first = some.groupBy("sequence").agg(F.min(rank).alias("first"), leader)
    leaders = write_through(first.select("sequence", "first", "first.rid", "leader.*"), "near-leaders")
    n_leaders = leaders.count()

    # Both sides of these joins grow with the input: merge joins at every size, never a broadcast.
    keys = leaders.select("rid", F.explode("bands").alias("band"))
    sizes = _sized(keys, "band")
    bucketed = _blocked(keys, sizes, "band", "rid", BANDS * n_leaders).join(leaders.select("rid", "sketch").hint("merge"), "rid")
    candidates = write_through(_by_group(bucketed, ["band", "low", "high"], "sketch", partial(_candidates, least=let_pass(similarity))), "near-candidates", drop=(sizes,))
    clusters = connected(candidates)

    weighed = write_through(clusters.withColumnRenamed("node", "rid").join(leaders.select("rid", "loc", "n_shingles").hint("merge"), "rid"), "near-clusters", drop=(candidates, clusters))
    sizes = _sized(weighed, "component", "n_shingles")
    members = _blocked(weighed, sizes, "component", "rid", weighed.count()).join(read.select("loc", "text").hint("merge"), "loc").drop("loc")
    links = write_through(_by_group(members, ["component", "low", "high"], "text", partial(_confirmed, similarity=similarity)), "near-links", drop=(weighed, sizes))
    found = connected(links)
    # Leaders are linked to each other; the least row of a component is the least of its leaders' firsts.
    rooted = leaders.join(found.select(F.col("node").alias("rid"), F.col("component").alias("root")).hint("merge"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    rooted = write_through(rooted.select("sequence", "root", "first"), "near-rooted", drop=(links, found, leaders))
    least = write_through(rooted.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n")), "near-least")
    named = write_through(spread_join(rooted.select("root", "sequence"), least, "root", "n", F.lit(n_leaders)).select("sequence", "least"), "near-named", drop=(rooted, least))
    shared = some.join(named.hint("merge"), "sequence").select("loc", "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("rid") == F.col("least.rid")).alias("kept"))
    alone = signed.where("sequence is null").select("loc", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return write_through(shared.unionByName(alone), "near-result", drop=(named, signed))


def near_report(docs: DataFrame, similarity: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    table = stored(docs if is_table(docs) else docs.select("doc_id", "text"), "near-docs")
    return _components(table, similarity).drop("loc")


def drop_near(docs: DataFrame, similarity: int = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with its columns."""
    table = stored(docs, "near-docs")
    kept = _components(table, similarity).where("kept").select("loc")
    return table.join(kept.hint("merge"), "loc", "left_semi").select("row.*")
