"""Toxicity by weak supervision.

Voters vote on each text or abstain: lexicon voters (a word of a list) and pattern voters (a word that begins with a
stem), for toxic or for clean. Labelled rows only choose the voters: words and word beginnings that one kind of row holds
far more often than the other. From there on the labels are hidden. A generative label model over the votes alone, fitted
by EM, estimates each voter's accuracy and the correlations of voters: given the label, a vote depends on that of one other voter,
and the voters form the tree whose links explain the most. An abstention is no evidence: a toxic text needn't hold the
words of every list. Where nothing but a voter itself speaks for or against it, it keeps the accuracy it started with. The posteriors it gives are what a linear classifier over the
votes and their counts is trained on; the classifier scores every text. Last, two numbers, a scale and a shift of the
classifier's logit, are calibrated on the labels.

Voters and models are fitted on at most SAMPLE_ROWS labelled rows, those of least hash; scoring takes whole texts of all
rows. No label, language, source or id enters a score.

Defined results: a null text counts as empty and gets a score; rows of a doc_id that is null are never used for
fitting, their held_out is null; repeated rows get a row each, and the least label of a doc_id counts; without labelled rows every
score is the prior; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from deltaloom.llm.exchange import release
from deltaloom.session import ship_package, staged
from deltaloom.sources.tables import table

SAMPLE_ROWS = 10_000
#: Stems of this many characters; voters of each kind; rows that a word must be in; odds that it must have.
STEM, VOTERS, LEAST_ROWS, LEAST_ODDS = 5, 96, 3, 40.0
PRIOR = 0.1
#: Rounds of EM, pseudo-rows that hold each chance back, and the least information a row that links two voters.
ROUNDS, PSEUDO, LEAST_LINK = 20, 1.0, 0.002
#: Accuracy that EM starts from; what a text without votes is taken to be, and rows of it that the classifier sees.
START, SILENT, SILENT_ROWS = 0.95, 0.01, 10
WORDS = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> set[str]:
    """Words of a text, and w* for the beginnings of its longer words."""
    words = set(WORDS.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in (STEM - 1, STEM) if len(w) > n}


@dataclass
class Model:
    voters: list[str]
    toxic: np.ndarray  # whether a voter votes toxic
    labels: LabelModel | None
    weights: np.ndarray
    bias: float

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Votes, then the logarithm of the number of votes for toxic and for clean, and whether there is one for toxic."""
        place = {v: i for i, v in enumerate(self.voters)}
        x = np.zeros((len(texts), len(self.voters) + 3))
        for r, text in enumerate(texts):
            hits = [place[t] for t in tokens(text) if t in place]
            x[r, hits] = 1.0
            n = self.toxic[hits].sum()
            x[r, -3:] = np.log1p(n), np.log1p(len(hits) - n), n > 0
        return x

    def score(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.features(texts) @ self.weights + self.bias)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def mine_voters(rows: list[tuple[str | None, int]]) -> tuple[list[str], list[bool]]:
    """Words and beginnings whose odds of standing in rows of one kind are high, best first within each kind."""
    found = [Counter(), Counter()]
    for text, label in rows:
        found[label].update(tokens(text))
    n = [sum(1 for _, y in rows if y == k) for k in (0, 1)]
    voters: list[str] = []
    toxic: list[bool] = []
    for own in (1, 0):
        if not n[own] or not n[1 - own]:
            continue
        # a clean voter has to stand in as many of its rows as the toxic ones expected by chance, lest rarity make it one
        least = LEAST_ROWS if own else max(LEAST_ROWS, LEAST_ROWS * n[0] / n[1])
        odds = {t: ((c + 0.1) / (n[own] + 1)) / ((found[1 - own][t] + 0.1) / (n[1 - own] + 1)) for t, c in found[own].items() if c >= least}
        good = sorted((t for t, o in odds.items() if o >= LEAST_ODDS), key=lambda t: (-found[own][t] * np.log(odds[t]), t))
        mine = [t for t in good if not t.endswith("*")][:VOTERS] + [t for t in good if t.endswith("*")][:VOTERS]
        voters += mine
        toxic += [bool(own)] * len(mine)
    return voters, toxic


@dataclass
class LabelModel:
    toxic: np.ndarray  # what each voter votes for
    accuracy: np.ndarray  # of each voter: the chance that its vote is right
    parent: np.ndarray  # the voter that each voter's vote depends on, -1 for none
    correlation: np.ndarray  # with that voter, given the label
    chance: np.ndarray  # of a vote, by label and the parent's vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance that each row is toxic, from its votes alone."""
        above = np.where(self.parent >= 0, votes[:, self.parent], 0) > 0
        odds = np.log(self.chance[1]) - np.log(self.chance[0])  # of a vote, by the parent's
        odds = np.where(self.toxic, np.maximum(odds, 0), np.minimum(odds, 0))  # no vote speaks against itself
        p = sigmoid(np.log(PRIOR / (1 - PRIOR)) + (votes * np.where(above, odds[1], odds[0])).sum(axis=1))
        return np.where(votes.any(axis=1), p, SILENT)


def _tree(gain: np.ndarray) -> np.ndarray:
    """The parent of each voter in the tree (or trees) of greatest gain; links below LEAST_LINK are none."""
    k = len(gain)
    parent, best, done = np.full(k, -1), np.zeros(k), np.zeros(k, bool)
    for _ in range(k):
        i = int(np.where(done, -1.0, best).argmax())
        done[i] = True
        closer = ~done & (gain[i] > best) & (gain[i] >= LEAST_LINK)
        best[closer], parent[closer] = gain[i][closer], i
    return parent


def label_model(votes: np.ndarray, toxic: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, LabelModel]:
    """Posterior of toxic for each row, and the model. votes: rows by voters, 1 for a vote; toxic: what each votes for.

    EM from the guess that a row with votes is what most of them say and one without is clean. Given the label the
    votes are a tree, found anew in each round from the conditional information of all pairs of voters."""
    n, k = votes.shape
    balance = votes @ np.where(toxic, 1.0, -1.0)
    p = np.where(balance > 0, START, np.where(balance < 0, 1 - START, SILENT))
    for _ in range(rounds):
        gain, tables = np.zeros((k, k)), []
        for y in (0, 1):
            w = p if y else 1 - p
            total = w.sum() + 2 * PSEUDO
            on = votes.T @ w + 2 * PSEUDO * 0.01
            both = (votes * w[:, None]).T @ votes
            single = on / total
            independent = np.outer(on, on) / total
            joint = (both + PSEUDO * independent / total) / (1 + PSEUDO / total)
            for a in (0, 1):
                for b in (0, 1):
                    cell = joint if a and b else on[:, None] - joint if a else on[None, :] - joint if b else total - on[:, None] - on[None, :] + joint
                    chance = np.outer(single if a else 1 - single, single if b else 1 - single) * total
                    cell = np.maximum(cell, 1e-9)
                    gain += cell * np.log(cell / chance) / n
            tables.append((total, on, joint))
        np.fill_diagonal(gain, 0)
        parent = _tree(gain)
        chance = np.empty((2, 2, k))
        spread = np.zeros(k)
        for y, (total, on, joint) in enumerate(tables):
            rate = on / total
            up, own = np.maximum(parent, 0), np.arange(k)
            n_up = np.where(parent >= 0, on[up], 0)
            n_both = np.where(parent >= 0, joint[own, up], 0)
            chance[y, 1] = (n_both + PSEUDO * rate) / (n_up + PSEUDO)
            chance[y, 0] = (on - n_both + PSEUDO * rate) / (total - n_up + PSEUDO)
            part = (n_both / total - rate * rate[up]) / np.sqrt(rate * (1 - rate) * rate[up] * (1 - rate[up]))
            spread += np.where(parent >= 0, part * total, 0) / (n + 4 * PSEUDO)
        chance = np.clip(chance, 1e-6, 1 - 1e-6)
        on0, on1 = (on / total for total, on, _ in tables)
        each = np.stack([on0 * (1 - PRIOR), on1 * PRIOR])
        model = LabelModel(toxic, each[toxic.astype(int), np.arange(k)] / each.sum(axis=0), parent, spread, chance)
        p = model.posterior(votes)
    return p, model


def linear(x: np.ndarray, p: np.ndarray, rounds: int = 30, ridge: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression on posteriors by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        q = sigmoid(z @ w)
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.diag(penalty), z.T @ (p - q) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(labelled: list[tuple[str | None, int]]) -> Model:
    """Labels choose the voters and calibrate the end; the label model and the classifier don't see them."""
    voters, toxic = mine_voters(labelled)
    model = Model(voters, np.array(toxic, bool), None, np.zeros(len(voters) + 3), float(np.log(PRIOR / (1 - PRIOR))))
    if not voters:
        return model
    x = model.features([t for t, _ in labelled])
    p, model.labels = label_model(x[:, : len(voters)], model.toxic)
    silent = np.zeros((SILENT_ROWS, x.shape[1]))  # so that a text without votes is clean even if all sampled ones have some
    weights, bias = linear(np.vstack([x, silent]), np.concatenate([p, np.full(SILENT_ROWS, SILENT)]))
    scale, shift = linear((x @ weights + bias)[:, None], np.array([y for _, y in labelled], float))
    if scale[0] > 0:
        weights, bias = weights * scale[0], bias * scale[0] + shift
    model.weights, model.bias = weights, bias
    del x, p, silent
    release()  # what the driver's later steps need
    return model


def fold(ids: Column) -> Column:
    return F.crc32(ids.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> list[tuple[str | None, int]]:
    """At most `most` labelled rows, of the least hashes of doc_id, none of them held out.

    A cut of the hashes, from the number of labelled ids, leaves about `most` ids before any are sorted."""
    known = labels.filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).distinct().join(known, "doc_id").withColumn("_h", h)
    n = ids.count()
    cut = (1 << 31) * 1.1 * most / max(n, 1)
    chosen = staged(ids.filter(F.col("_h") < F.lit(cut)).orderBy("_h", "doc_id").limit(most).select("doc_id", "toxic", "_h"), "sample")
    # chosen is bounded by `most`, so it may be broadcast
    rows = staged(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample-texts")
    first = rows.orderBy("_h", "doc_id", F.xxhash64("text")).limit(most) if rows.count() > most else rows  # an id with many rows
    return [(r["text"], int(r["toxic"] > 0)) for r in sorted(first.collect(), key=lambda r: (r["_h"], r["doc_id"], r["text"] or ""))]


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with one more column, the score; docs has no column of that name."""
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 512):
                part = whole.slice(i, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(part.column(at).to_pylist()), pa.float64())], names=[*part.schema.names, name])
                del part
                release()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model fitted outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
