"""Toxicity by weak supervision.

Voters: stems (beginnings of words, or words) that are far more frequent in toxic than in other
labelled documents (the lexicon), how many of them a text has, and patterns of writing (shouting, exclamation, signs, address). A
generative label model holds the chance of a toxic document, each voter's chance to fire given the
class, and the correlations of voters beyond the class, by which the votes of those that fire
together are discounted. It is fitted by expectation maximisation; the given labels are one more
voter, whose accuracy is estimated like the others'. A logistic classifier on the voters' features
is then trained on the posterior labels and scores every whole text.

Stems are counted over all labelled rows. The lexicon is the ``lexicon_size`` of most evidence (of
sixty times as many candidates). Only the label model and the classifier are fitted on a sample: at
most ``sample_rows`` labelled documents, half of them for each class (what one class leaves the other
has), those of least hash of doc_id; its posterior odds and the classifier's rows are then weighted to
the classes' sizes. That much reaches the driver.

Defined cases: null and empty texts have the score of a text without any vote; without labelled
rows of both classes every score is the share of toxic labels (0 if none); null labels are not
used; of several labels of a document the greatest counts; null doc_ids are not held out;
repeated rows are scored alike; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrec.llm.langid import held_out

WORD = re.compile(r"[^\W\d_]+")
#: Patterns of writing, each a share of the text's words.
PATTERNS = (("shout", re.compile(r"\b[A-Z]{3,}\b")), ("exclaim", re.compile(r"!")), ("signs", re.compile(r"[#*$%&|<>]")), ("address", re.compile(r"\b(?:you|your|du|tu|vous|usted)\b", re.I)), ("link", re.compile(r"https?://")))
#: Lengths of stems, and what of a word is looked at first.
STEMS, SHORTEST = (3, 4, 5, 6, 8), 3
OUT_SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Lexicon:
    """Stems by number; a stem is in every word that begins with it."""

    def __init__(self, stems: list[str]):
        self.index = {stem: k for k, stem in enumerate(stems)}
        self.starts = {stem[:SHORTEST] for stem in stems}
        self.lengths = sorted({len(stem) for stem in stems})

    def hits(self, words: list[str]) -> Counter:
        found: Counter = Counter()
        starts = self.starts
        for word in words:
            if word[:SHORTEST] in starts:
                found.update(k for n in self.lengths if n <= len(word) and (k := self.index.get(word[:n])) is not None)
        return found


def stems_of(words: list[str]) -> set[str]:
    """The words and their beginnings of STEMS characters."""
    distinct = set(words)
    return distinct | {w[:n] for w in distinct for n in STEMS if n < len(w)}


@dataclass
class Model:
    stems: list[str]
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.bias)
        lexicon = Lexicon(self.stems)
        x = np.array([features(t, lexicon) for t in texts]).reshape(len(texts), -1) / self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.weights + self.bias, -50, 50)))


def features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """Of each stem whether it occurs; then of all of them: distinct, occurrences and share of words; then the patterns' shares."""
    words = tokens(text)
    k = len(lexicon.index)
    out = np.zeros(k + 3 + len(PATTERNS))
    hits = lexicon.hits(words)
    out[list(hits)] = 1.0
    n, total = max(1, len(words)), sum(hits.values())
    out[k : k + 3] = np.log1p(len(hits)), np.log1p(total), min(1.0, 20.0 * total / n)
    for j, (_, pattern) in enumerate(PATTERNS):
        out[k + 3 + j] = min(1.0, len(pattern.findall(text)) / n) if text else 0.0
    return out


def votes_of(x: np.ndarray, n_stems: int) -> np.ndarray:
    """0/1 votes: each stem; one, two and four distinct stems or more; each pattern at a tenth and at half of the words."""
    distinct = np.expm1(x[:, n_stems])
    patterns = x[:, n_stems + 3 :]
    return np.hstack([x[:, :n_stems] > 0, distinct[:, None] >= np.array([0.5, 1.5, 3.5]), patterns >= 0.1, patterns >= 0.5]).astype(float)


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of the toxic class for each row.

    ``given`` are the labels, one more voter. Voter j's discount is 1 / (1 + sum of its absolute
    correlations with the other voters within the classes).
    """
    all_votes = np.hstack([votes, given[:, None]])
    posterior = np.clip(given.astype(float), 0.02, 0.98)
    for _ in range(rounds):
        mass = np.array([1 - posterior, posterior])
        prior = np.clip(mass.sum(axis=1) / len(posterior), 1e-3, 1)
        fire = (mass @ all_votes + 0.5) / (mass.sum(axis=1)[:, None] + 1.0)
        rest = all_votes - (mass.T @ fire)
        rest /= np.sqrt((rest**2).sum(axis=0)) + 1e-9
        together = np.abs(rest.T @ rest)
        np.fill_diagonal(together, 0.0)
        together[together < 0.1] = 0.0
        discount = 1.0 / (1.0 + together.sum(axis=0))
        log_fire, log_not = np.log(fire), np.log(1 - fire)
        logits = np.log(prior) + ((all_votes[:, None, :] * log_fire + (1 - all_votes[:, None, :]) * log_not) * discount).sum(axis=2)
        new = 1.0 / (1.0 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -50, 50)))
        if np.abs(new - posterior).max() < 1e-4:
            return new
        posterior = new
    return posterior


def fit_linear(x: np.ndarray, soft: np.ndarray, ridge: float = 1.0, rounds: int = 25, row_weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    weigh = np.ones(len(x)) if row_weights is None else row_weights
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -50, 50)))
        step = np.linalg.solve((z * (weigh * (p * (1 - p) + 1e-6))[:, None]).T @ z + np.diag(penalty), z.T @ (weigh * (soft - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, sample_rows: int = 8_000, lexicon_size: int = 256, least_docs: int = 5) -> Model:
    allowed = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Labels grow with the corpus: the joins are merge joins at every size, never a broadcast.
    labelled = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold)).join(allowed.hint("merge"), "doc_id")
    present = labelled.groupBy("doc_id", (F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        totals = {r["toxic"]: (r["n"], r["ids"]) for r in present.groupBy("toxic").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids")).collect()}
        (n_toxic, toxic_ids), (n_clean, clean_ids) = totals.get(1, (0, 0)), totals.get(0, (0, 0))
        if not n_toxic or not n_clean:
            return Model([], np.empty(0), np.empty(0), float(n_toxic > 0))

        def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"toxic": batch["toxic"], "stems": [list(stems_of(tokens(t))) for t in batch["text"]]})

        counts = (
            labelled.select("toxic", "text").mapInPandas(distinct, "toxic int, stems array<string>")
            .select("toxic", F.explode("stems").alias("stem"))
            .groupBy("stem")
            .agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("t"), F.count(F.lit(1)).alias("n"))
        )
        # How far a stem's share of toxic documents is from that of all: n times the divergence of the two.
        base, share = n_toxic / (n_toxic + n_clean), F.col("t") / F.col("n")
        rest = F.when(F.col("t") < F.col("n"), (F.col("n") - F.col("t")) * F.log((1 - share) / (1 - base))).otherwise(F.lit(0.0))
        evident = counts.where((F.col("t") >= least_docs) & (share >= 3 * base)).withColumn("evidence", F.col("t") * F.log(share / base) + rest).where(F.col("evidence") >= 16)
        best = evident.orderBy(F.desc("evidence"), F.desc(F.length("stem")), "stem").limit(60 * lexicon_size).collect()
        stems: list[str] = []
        for row in best:
            # Of a stem and its beginnings the first taken speaks for all.
            if len(stems) < lexicon_size and not any(row["stem"].startswith(s) or s.startswith(row["stem"]) for s in stems):
                stems.append(row["stem"])
        lexicon = Lexicon(stems)
        half = sample_rows // 2
        shares = {1: min(toxic_ids, max(half, sample_rows - clean_ids)), 0: min(clean_ids, max(sample_rows - half, sample_rows - toxic_ids))}
        in_order = [F.xxhash64("doc_id"), F.col("doc_id")]
        chosen = present.where("toxic = 1").orderBy(*in_order).limit(shares[1]).unionByName(present.where("toxic = 0").orderBy(*in_order).limit(shares[0]))
        # Bounded by sample_rows ids, so it may be broadcast.
        sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")

        def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"toxic": batch["toxic"], "x": [features(t, lexicon) for t in batch["text"]]})

        rows = sample.mapInPandas(featured, "toxic int, x array<double>").collect()
    finally:
        present.unpersist()
    rows.sort(key=lambda r: (r["x"], r["toxic"]))
    x = np.array([r["x"] for r in rows])
    given = np.array([float(r["toxic"] == 1) for r in rows])
    # Weighted to the classes' sizes; the class of which most was taken weighs 1 a row.
    per_row = np.array([n_clean / max(1, (given == 0).sum()), n_toxic / max(1, (given == 1).sum())])
    row_weights = (per_row / per_row.min())[given.astype(int)]
    soft = label_model(votes_of(x, len(stems)), given)
    soft = soft * per_row[1] / (soft * per_row[1] + (1 - soft) * per_row[0])
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    weights, bias = fit_linear(x / scale, soft, row_weights=row_weights)
    return Model(stems, scale, weights, bias)


_models: dict[str, Model] = {}


def _model(key: str, sent) -> Model:
    if key not in _models:
        _models.clear()
        _models[key] = sent.value
    return _models[key]


def score(docs: DataFrame, model: Model, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _model(key, sent)
        for batch in batches:
            values = own.score([t if isinstance(t, str) else None for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": values, "predicted": (values >= 0.5).astype("int32")})

    return docs.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text").mapInPandas(run, OUT_SCHEMA)
