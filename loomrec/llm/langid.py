"""Language identification by compression.

Each language has a zstandard dictionary of raw content: training texts of that language. A text is
compressed with every dictionary, in segments, so the dictionary tells as much at the end of a long
text as at its beginning; the language of the smallest sum wins. Where the margin to the second is
narrow the answer is marked as rejected.

Training takes at most ``per_lang`` rows of each language, those of least hash, and of each a piece
from anywhere in its text; all languages are learned. Samples that the first dictionaries take for another language are left out of the second.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without training rows
all are ``und``; very long texts are compressed whole, segment by segment; null langs are never learned; a null doc_id is not trained on and not held out;
repeated rows are judged alike; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 4096
LEVEL = 9
#: Margins (share of the second's size) below this are rejected.
NARROW = 0.01
LETTERS = re.compile(r"[^\W\d_]+")
OUT_SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, margin double, rejected boolean"


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def letters(text: str) -> bytes:
    """The lower-cased runs of letters of a text: digits and signs tell nothing of its language."""
    return " ".join(LETTERS.findall(text.lower())).encode("utf-8", "surrogatepass")


class Compressors:
    """One compressor a language."""

    def __init__(self, contents: dict[str, bytes]):
        import zstandard

        self.langs = list(contents)
        self.made = []
        for lang in self.langs:
            words = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = letters(text)
        parts = [data[i : i + SEGMENT] for i in range(0, len(data), SEGMENT)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.made]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin); of equal sizes the language first by name."""
        if text is None or not self.langs or not LETTERS.search(text):
            return "und", 0.0, 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = sizes[order[0]]
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0
        score = 1.0 / sum(math.exp(max(-700.0, (best - s) / 8.0)) for s in sizes)
        return self.langs[order[0]], score, (sizes[order[1]] - best) / sizes[order[1]]


def learn(train: DataFrame, per_lang: int = 200, sample_chars: int = 4096, dict_bytes: int = 98_304, total_bytes: int = 64 << 20) -> dict[str, bytes]:
    """Dictionary contents by language, from rows doc_id, text, lang.

    Of each language ``per_lang`` rows are learned from, those of least hash of id and text, and of
    a row a piece of ``sample_chars`` characters that begins anywhere in its text, by that hash.
    All languages share ``total_bytes`` of the driver's memory: with very many, each has fewer rows
    and a smaller dictionary; it is an error if not even a row of each finds room.
    """
    rows = train.where("lang is not null and text is not null and doc_id is not null")
    n_langs = rows.select("lang").distinct().count()
    share = total_bytes // max(1, n_langs)
    taken = min(per_lang, share // (4 * sample_chars))
    if not taken:
        raise ValueError(f"{n_langs} languages do not fit into total_bytes={total_bytes}")
    # By each language's number of different rows, only hashes are looked at below which three times
    # the rows wanted, and twenty more, are expected; so what is sent does not grow with the table.
    # A row that is there many times counts once.
    h = F.xxhash64("doc_id", "text")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(h, 0.02).alias("n"))
    low = F.shiftrightunsigned(F.col("h"), 11) / float(1 << 53) * F.col("n") <= 3 * taken + 20
    begin = F.pmod(F.col("h"), F.greatest(F.length("text") - sample_chars + 1, F.lit(1)).cast("long")).cast("int") + 1
    hashed = rows.select("doc_id", "lang", h.alias("h"), "text").join(F.broadcast(sizes), "lang").where(low)
    pieces = hashed.select("doc_id", "lang", "h", F.col("text").substr(begin, F.lit(sample_chars)).alias("piece")).dropDuplicates(["lang", "h"])
    least = Window.partitionBy("lang").orderBy("h", "doc_id", "piece")
    texts = pieces.withColumn("k", F.row_number().over(least)).where(F.col("k") <= taken)
    found: dict[str, list[str]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["lang"], r["k"])):
        found.setdefault(r["lang"], []).append(r["piece"])

    def contents(of: dict[str, list[str]]) -> dict[str, bytes]:
        # The end of a dictionary is nearest to the text; what does not fit is cut evenly off all pieces.
        out = {}
        for lang, parts in of.items():
            made = [x for x in map(letters, parts) if x]
            total, most = sum(map(len, made)), min(dict_bytes, share)
            if made:
                out[lang] = b"\n".join(x[: max(1, len(x) * most // total)] for x in made) if total > most else b"\n".join(made)
        return out

    if len(contents(found)) < 2:
        return contents(found)
    # A text is in its own language's dictionary, so it is judged by halves of the sample that lack it.
    halves = [Compressors(contents({lang: t[k::2] for lang, t in found.items()})) for k in (0, 1)]
    clean = {lang: [x for i, x in enumerate(t) if halves[1 - i % 2].judge(x)[0] == lang] for lang, t in found.items()}
    return contents({lang: clean[lang] or found[lang] for lang in found})


_made: dict[str, Compressors] = {}


def _compressors(key: str, contents) -> Compressors:
    """The worker's compressors of broadcast contents, made once in each worker."""
    if key not in _made:
        _made.clear()
        _made[key] = Compressors(contents.value)
    return _made[key]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected for every row of ``docs``; each whole text is compressed."""
    sent, key = docs.sparkSession.sparkContext.broadcast(dictionaries), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judges = _compressors(key, sent)
        for batch in batches:
            out = [judges.judge(t if isinstance(t, str) else None) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "held_out": batch["held_out"],
                    "lang_pred": [x[0] for x in out],
                    "score": [x[1] for x in out],
                    "margin": [x[2] for x in out],
                    "rejected": [x[2] < NARROW for x in out],
                }
            )

    return docs.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text").mapInPandas(run, OUT_SCHEMA)
