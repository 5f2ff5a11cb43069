"""Toxicity by the nearest labelled examples.

Features are words and the first bytes of longer ones. A bounded sample of
labelled rows gives the examples; features whose presence goes with the label
(chi-square, at the 1 % level and 1/150 of the variance, in four examples) make
the vocabulary, which has no bound but that of the examples. Over all features
the nearest texts are those of like subject, and the votes are worse (README).
Every document is compared with all examples by exact TF-IDF cosine in that
vocabulary: an inverted index in blocks of
examples keeps each feature's largest weight in a block, and blocks whose bound
cannot reach the nearest found so far are passed over. Votes are weighted by
the squared cosine, and a logistic curve, fitted to the examples' own votes with
each left out and weighed to the share of toxic rows among all labels, turns
them into a score.

The sample (``examples`` rows of each label at most, those of least hash) and
so the index have a fixed bound; the share of toxic labels is counted over all
labels, and every document is scored over its whole text.

Defined results: null and empty texts, and texts without any feature, get the
score of a vote without neighbours; a document with several labels is toxic if
one says so; null labels are not used; with no labels, or of one kind only, the
score is that share (0 without labels). Rows that share an id stay rows, and
count once among the examples with the most of each feature; examples at equal
distance follow their number; a text of any length is read in one piece; ids are
numbers, or texts of digits; an empty table yields no rows. Other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm import kernels as K
from geoloom.llm.store import ship_package

#: Labelled rows of each kind in the index, at most.
EXAMPLES = 1500
NEIGHBOURS = 15
#: One percent of features that have nothing to do with the label exceed this.
CHI_SQUARE, CHI_LEAST = 6.635, 4
#: Share of the label's variance that a feature has to tell, whatever the number of examples.
EFFECT = 1 / 150
BEGINNINGS = (4, 5, 6)
BLOCK = 64
#: Blocks looked at first; their nearest examples set the bound for the rest.
FIRST = 6

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SALT = K.splitmix(np.arange(64, dtype=np.uint64) + np.uint64(700))


def features(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all features with the number of their text."""
    folded = object.__new__(K.Texts)
    folded.id, folded.bytes, folded.at = texts.id, K.fold_latin1(texts.bytes), texts.at
    words = K.Words(folded, lower=True, between=_BETWEEN)
    hashes, text = [words.hash], [words.text]
    for n in BEGINNINGS:
        long = np.flatnonzero(words.end - words.start > n)
        hashes.append(K.slices_hash(words.folded, words.start[long], words.start[long] + n) ^ _SALT[n])
        text.append(words.text[long])
    return np.concatenate(hashes), np.concatenate(text)


@dataclass
class Index:
    """Examples' postings by feature and block, with each block's largest weight."""

    vocabulary: np.ndarray  # feature hashes, ascending
    idf: np.ndarray
    example: np.ndarray  # posting lists, one feature after the other, examples ascending
    weight: np.ndarray
    limits: np.ndarray  # feature x (blocks + 1): where each block's postings begin
    most: np.ndarray  # feature x blocks
    label: np.ndarray
    ids: np.ndarray
    curve: tuple[float, float] = (0.0, 0.0)

    @property
    def blocks(self) -> int:
        return self.most.shape[1]

    def near(self, feature: np.ndarray, weight: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine (over 0) and their cosines; ``but`` is left out."""
        bound = weight @ self.most[feature]
        order = np.argsort(-bound, kind="stable")
        score, found, least = np.zeros(len(self.label)), np.zeros(0, np.int64), 0.0
        limits = self.limits[feature]
        for some in (order[:FIRST], order[FIRST:]):  # the most promising blocks, then all that may still hold a nearer one
            some = some[bound[some] > least]
            if not len(some):
                break
            if 2 * len(some) > len(order):  # nearly all: whole posting lists are quicker than their blocks
                lo, ends, times = limits[:, 0], limits[:, -1], weight
                score[:] = 0.0
            else:
                lo, ends, times = limits[:, some].reshape(-1), limits[:, some + 1].reshape(-1), np.repeat(weight, len(some))
            size = ends - lo
            end = np.cumsum(size)
            where = np.arange(end[-1]) + np.repeat(lo - end + size, size)
            score += np.bincount(self.example[where], weights=self.weight[where] * np.repeat(times, size), minlength=len(score))
            if but >= 0:
                score[but] = 0.0
            found = np.flatnonzero(score)
            if len(found) > k:
                found = found[score[found] >= np.partition(score[found], -k)[-k]]
            if len(found) >= k:
                least = score[found].min()
        found = found[np.lexsort((found, -score[found]))][:k]
        return found, score[found]

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine * cosine
        return float(((w * self.label[found]).sum() + 0.1 * self.label.mean()) / (w.sum() + 0.1))

    def score(self, vote: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * _logit(vote) + b)))

    def vectors(self, hashes: np.ndarray, text: np.ndarray):
        """(text, features, normalised weights) of texts that have any feature of the vocabulary."""
        if not len(self.vocabulary) or not len(hashes):
            return
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        hit = self.vocabulary[place] == hashes
        both, count = np.unique(text[hit].astype(np.int64) << 32 | place[hit], return_counts=True)
        owner, feature = both >> 32, both & 0xFFFFFFFF
        weight = (1 + np.log(count)) * self.idf[feature]
        at = K.starts_of(owner)
        for i, j in zip(at, np.append(at[1:], len(owner))):
            yield owner[i], feature[i:j], weight[i:j] / np.sqrt((weight[i:j] ** 2).sum())


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def build(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> tuple[Index | None, float]:
    """The index and the share of toxic labels; None without both kinds of label."""
    known = labels.where(learn_from & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__toxic"))
    kinds = {r["__toxic"]: r["n"] for r in known.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(kinds.values())
    share = kinds.get(1, 0) / total if total else 0.0
    if not kinds.get(0) or not kinds.get(1):
        return None, share
    rank = F.xxhash64(F.lit(11), "__id")
    sample = [r for kind in (0, 1) for r in known.where(F.col("__toxic") == kind).orderBy(rank, "__id").limit(examples).collect()]  # 2 * examples rows
    ids = docs.sparkSession.createDataFrame([(r["__id"], r["__toxic"]) for r in sample], "__id long, __toxic int")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    texts = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("doc_id", "body")  # 2 * examples ids

    def counts(batches):
        for batch in batches:
            for t in K.pieces(batch):
                h, text = features(t)
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(t.id[text[at]]), pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(h))))], names=["doc_id", "feature", "n"])

    bags = texts.mapInArrow(counts, "doc_id long, feature long, n long").groupBy("doc_id", "feature").agg(F.max("n").alias("n")).join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    size = {kind: sum(r["__toxic"] == kind for r in sample) for kind in (0, 1)}
    n = size[0] + size[1]
    expected = F.col("both") * (size[1] / n)
    presence = bags.groupBy("feature").agg(F.count("*").alias("both"), F.sum("__toxic").alias("with"))
    chi = presence.withColumn("chi", F.pow(F.col("with") - expected, 2) / expected + F.pow(F.col("with") - expected, 2) / (F.col("both") * (size[0] / n)))
    strong = chi.where((F.col("chi") >= max(CHI_SQUARE, EFFECT * n)) & (F.col("both") >= CHI_LEAST))
    rows = bags.join(strong.select("feature", "both"), "feature").select("doc_id", "feature", "n", "both").toArrow()  # bounded by the examples' texts
    return _index([(r["__id"], r["__toxic"]) for r in sample], rows, share, neighbours), share


def _index(sample: list[tuple[int, int]], rows: pa.Table, share: float, neighbours: int) -> Index:
    hashes = rows.column("feature").to_numpy().view(np.uint64)
    vocabulary, feature = np.unique(hashes, return_inverse=True)
    both = np.zeros(len(vocabulary))
    both[feature] = rows.column("both").to_numpy()
    idf = np.log((1 + len(sample)) / (1 + both)) + 1e-9
    owner = rows.column("doc_id").to_numpy()
    weight = (1 + np.log(rows.column("n").to_numpy())) * idf[feature]
    # like examples stand together, so that a block's bound is tight: by label, then by their heaviest feature
    heavy: dict[int, tuple[float, int]] = {}
    for o, f, w in zip(owner.tolist(), feature.tolist(), weight.tolist()):
        heavy[o] = max(heavy.get(o, (0.0, -1)), (w, f))
    ordered = sorted(sample, key=lambda r: (r[1], heavy.get(r[0], (0.0, -1))[1], r[0]))
    number = {r[0]: k for k, r in enumerate(ordered)}
    example = np.array([number[o] for o in owner.tolist()], dtype=np.int64)
    norm = np.sqrt(np.bincount(example, weights=weight**2, minlength=len(ordered)))
    weight = weight / norm[example] if len(example) else weight
    order = np.lexsort((example, feature))
    example, feature, weight = example[order], feature[order], weight[order]
    blocks = max(1, -(-len(ordered) // BLOCK))
    cell = feature * blocks + example // BLOCK
    limits = np.searchsorted(cell, np.arange(len(vocabulary) * blocks + 1))
    most = np.zeros(len(vocabulary) * blocks)
    np.maximum.at(most, cell, weight)
    grid = np.arange(len(vocabulary))[:, None] * blocks + np.arange(blocks + 1)
    index = Index(vocabulary, idf, example, weight, limits[grid], most.reshape(-1, blocks), np.array([r[1] for r in ordered]), np.array([r[0] for r in ordered], dtype=np.int64))
    # each example's vote by the others, weighed to the share of toxic labels
    votes = np.full(len(ordered), index.vote(np.zeros(0, np.int64), np.zeros(0)))
    by = np.lexsort((feature, example))
    at = K.starts_of(example[by])
    for i, j in zip(at, np.append(at[1:], len(by))):
        part = by[i:j]
        votes[example[part[0]]] = index.vote(*index.near(feature[part], weight[part], neighbours, but=int(example[part[0]])))
    index.curve = _fit(_logit(votes), index.label, share)
    return index


def _fit(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """A logistic curve by Newton's method, with a weak pull to slope 1."""
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    beta, m = np.array([1.0, 0.0]), np.stack((x, np.ones(len(x))), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(m @ beta)))
        grad = m.T @ (w * (p - y)) + np.array([1.0, 0.01]) * (beta - np.array([1.0, 0.0]))
        hess = (m * (w * p * (1 - p))[:, None]).T @ m + np.diag([1.0, 0.01])
        step = np.linalg.solve(hess, grad)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def score(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, neighbours: int = NEIGHBOURS, keep: list[str] | None = None, with_evidence: bool = True) -> DataFrame:
    """``docs``' columns in ``keep`` (by default the id) with tox_score and, behind it, tox_evidence, the ids of the nearest examples.

    ``learn_from`` is a condition on ``labels``; only rows that meet it are learned. If ``keep`` has a column tox_score
    or tox_evidence, underscores follow the new one's name.
    """
    ship_package(docs.sparkSession)
    index, share = build(docs, labels, learn_from, id_col, text_col, label_col, examples, neighbours)
    keep = [id_col] if keep is None else keep
    named = ["tox_score"] + ["tox_evidence"] * with_evidence
    for i, name in enumerate(named):
        while named[i].lower() in {c.lower() for c in keep}:
            named[i] += "_"
    if index is None:
        return docs.select(*keep, F.lit(float(share)).alias(named[0]), *(F.array().cast("array<bigint>").alias(n) for n in named[1:]))

    def work(batches):
        base = index.vote(np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            done = 0
            for texts in K.pieces(batch):
                n = len(texts)
                votes, evidence = np.full(n, base), [[] for _ in range(n)]
                for t, feature, weight in index.vectors(*features(texts)):
                    found, cosine = index.near(feature, weight, neighbours)
                    votes[t] = index.vote(found, cosine)
                    evidence[t] = index.ids[found[:3]].tolist()
                rest = batch.slice(done, n).select(names)
                done += n
                more = [pa.array(evidence, pa.list_(pa.int64()))] if with_evidence else []
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(index.score(votes)), *more], names=[*names, "tox_score", *keep_evidence])

    # a text that is kept travels once, under the name by which it is read
    keep_evidence = ["tox_evidence"] * with_evidence
    names = ["body" if c == text_col else f"k{i}" for i, c in enumerate(keep)]
    body = [] if "body" in names else [F.coalesce(F.col(text_col), F.lit("")).alias("body")]
    asked = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(id_col).cast("long").alias("doc_id"), *body)
    kept = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(keep, names))
    out = asked.mapInArrow(work, f"{kept}, tox_score double" + ", tox_evidence array<long>" * with_evidence)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), *(F.col(c).alias(n) for c, n in zip(("tox_score", "tox_evidence"), named)))
