"""Toxicity by weak supervision.

Many weak voters look at each text: the words of a small lexicon, words and stems induced from labelled rows (a stem is
a prefix, written ~stem, or ~~stem if several words of a text must have it), and patterns. A generative label model with
a latent class estimates the rates of the voters in either class by expectation maximisation over the vote patterns of
all documents. Correlations within a class are modelled by a tree: of all pairs of voters those with the most mutual
information, given the class, are linked, and a voter's rates depend on the vote of the one before it in the tree. The
posteriors of the model are the labels of a linear classifier, whose scores are calibrated on labelled rows.

Labels are learned only from rows outside the held-out fold (crc32 of the id as text, modulo 4, is 2). All statistics
of votes cover all documents. Two samples are bounded, both taken by hashes of ids: the labelled rows that induce words,
start the label model and calibrate (``sample_rows`` for each class, weighted by the inverse of the share that was taken
of their class), and the rows of all documents, labelled or not, whose posteriors the classifier is fitted to
(``fit_rows``). Voters are as many as pass the tests of ``induced_terms``; the driver holds a number for each pair.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm.shared import cut, documents, tidy

QUERY = "op9_toxicity"
ORACLE_SQL = None

# Terms of abuse in the languages of the corpus.
LEXICON = (
    "idiot moron loser worthless scum stupid dumb jerk bastard bitch asshole dickhead pathetic disgusting trash "
    "garbage clown creep freak vermin imbecile retard whore slut fuck fucking shit bullshit crap filth parasite "
    "dummkopf arschloch trottel abschaum wichser scheisse scheiße hurensohn idiota imbécil estúpido basura mierda "
    "puta cabrón gilipollas escoria imbécile connard salaud ordure merde crétin abruti débile putain"
).split()
PATTERNS = {
    "shut": re.compile(r"(?i)\b(?:shut up|go to hell|drop dead|screw you|kill yourself|get lost|ta gueule|halt's maul|cállate)\b"),
    "address": re.compile(r"(?i)\byou(?:'re| are) (?:a|an|such|so|nothing)\b"),
    "masked": re.compile(r"(?i)\b(?:f[*@#]{1,3}k\w*|sh[*!1]t|b[*!1]tch|a[*$]{2}hole)"),
    "nobody": re.compile(r"(?i)\bnobody (?:likes|wants|needs) you\b"),
}
SHOUT = re.compile(r"\b[A-Z]{4,}\b(?:\W+[A-Z]{4,}\b){2}")
BANGS = re.compile(r"[!?]{3,}")
WORD = re.compile(r"\w+")
STEMS = (4, 5, 6, 7)
#: Distinct words with a stem that make the voter ~~stem vote.
MANY = 3
LEET = str.maketrans("013457$@", "oieastsa")


def held_out(column: str = "doc_id"):
    """Rows of the held-out fold; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(True))


class Voters:
    """The voters in a fixed order: terms, patterns, then counts of hits."""

    def __init__(self, terms: list[str]):
        self.terms = {t: k for k, t in enumerate(terms) if t[0] != "~"}
        self.stems = {t.lstrip("~"): (k, MANY if t.startswith("~~") else 1) for k, t in enumerate(terms) if t[0] == "~"}
        self.lengths = sorted({len(t) for t in self.stems})
        self.names = [*terms, *PATTERNS, "shout", "bangs", "leet"]
        self.index = {n: k for k, n in enumerate(self.names)}

    def vote(self, text: str) -> tuple[np.ndarray, int, int]:
        """Votes as 0 and 1, how many words hit a term, and how many words there are."""
        low = text.lower()
        words = WORD.findall(low)
        votes = np.zeros(len(self.names), np.uint8)
        distinct = set(words)
        found = distinct & self.terms.keys()
        for w in found:
            votes[self.terms[w]] = 1
        for length in self.lengths:
            stemmed = Counter(w[:length] for w in distinct if w[:length] in self.stems)
            for stem, n in stemmed.items():
                if n >= self.stems[stem][1]:
                    votes[self.stems[stem][0]] = 1
                    found |= {w for w in distinct if w.startswith(stem)}
        for w in distinct:
            if not w.isalpha() and not w.isdigit() and w.translate(LEET) in self.terms:
                votes[self.index["leet"]] = 1
        hits = sum(words.count(w) for w in found)
        for name, pattern in PATTERNS.items():
            votes[self.index[name]] = pattern.search(low) is not None
        votes[self.index["shout"]] = SHOUT.search(text) is not None
        votes[self.index["bangs"]] = BANGS.search(text) is not None
        return votes, hits, len(words)


def cast_votes(docs: DataFrame, voters: Voters, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep``, votes (packed bits), hits and n_words for every row."""
    fields = ["doc_id", *keep]
    schema = docs.select(*fields).schema
    for name, kind in (("votes", "binary"), ("hits", "integer"), ("n_words", "integer")):
        schema = schema.add(name, kind)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [voters.vote(t.as_py() or "") for t in batch.column("text")]
            columns = [batch.column(f) for f in fields]
            columns += [pa.array([np.packbits(v).tobytes() for v, _, _ in rows], pa.binary()), pa.array([h for _, h, _ in rows], pa.int32()), pa.array([n for _, _, n in rows], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*fields, "votes", "hits", "n_words"])

    return docs.select(*fields, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the labelled documents outside the held-out fold; of labels of both kinds toxic counts."""
    return labels.filter(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def class_weights(labels: DataFrame, rows: int) -> np.ndarray:
    """For the clean and the toxic class, how many training labels each one that was taken stands for.

    This is the inverse of the share taken; labels without a document are missing from the sample in the same share.
    """
    sizes = {int(r["toxic"]): r["n"] for r in training_labels(labels).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return np.array([max(1.0, sizes.get(y, 0) / max(rows, 1)) for y in (0, 1)])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, toxic of at most ``rows`` training documents of each class, chosen by a hash of the id."""
    usable = training_labels(labels)
    picked = [usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    return docs.select("doc_id", "text").join(F.broadcast(picked[0].union(picked[1])), "doc_id")


def grams(text: str) -> set[str]:
    """The distinct words of a text and their stems."""
    words = {w for w in WORD.findall(text.lower()) if 2 < len(w) < 40}
    stems = Counter(w[:k] for w in words for k in STEMS if len(w) > k)
    return words | {"~" + t for t in stems} | {"~~" + t for t, n in stems.items() if n >= MANY}


def induced_terms(sample: DataFrame, known: set[str], least_docs: int = 4, least_ratio: float = 15.0, least_evidence: float = 20.0) -> list[str]:
    """Words and stems that labelled toxic documents hold far more often than clean ones.

    Tests: documents, the quotient of the two shares, and twice the log likelihood of the counts against equal shares.
    """
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return []

    @tidy
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                counts[toxic.as_py()].update(grams(text.as_py() or ""))
            found = counts[0] | counts[1]
            columns = [pa.array(list(found), pa.string()), *(pa.array([counts[y][w] for w in found], pa.int64()) for y in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["word", "good", "bad"])

    each = sample.select("text", F.col("toxic").cast("int")).mapInArrow(words, "word string, good long, bad long")
    counts = each.groupBy("word").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ratio = (F.col("bad") / sizes[1]) / ((F.col("good") + 0.5) / sizes[0])
    share = F.lit(sizes[1] / (sizes[0] + sizes[1]))
    both = F.col("bad") + F.col("good")
    evidence = 2 * (F.col("bad") * F.log(F.col("bad") / (both * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (both * (1 - share)))).otherwise(0.0))
    kept_rows = counts.filter((F.col("bad") >= least_docs) & (ratio >= least_ratio)).filter(evidence >= least_evidence)
    rows = kept_rows.orderBy(F.desc("bad"), F.length("word"), "word").collect()
    kept: list[str] = []
    for r in rows:  # a longer or shorter form of what is kept says the same
        bare = r["word"].lstrip("~")
        if not any(bare.startswith(x) or x.startswith(bare) for x in (*known, *(t.lstrip("~") for t in kept))):
            kept.append(r["word"])
    return kept


@dataclass(frozen=True)
class LabelModel:
    """The share of the toxic class, and for each voter the one it depends on (-1: none) and its rates of voting by class
    and by that one's vote; those of a voter that depends on none are the same for either."""

    prior: float
    parent: np.ndarray
    rates: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        before = np.where(self.parent >= 0, votes[:, np.maximum(self.parent, 0)], 0) == 1
        odds = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        r = np.clip(self.rates, 1e-6, 1 - 1e-6)
        for sign, y in ((1, 1), (-1, 0)):
            rate = np.where(before, r[y, 1], r[y, 0])
            odds += sign * np.where(votes == 1, np.log(rate), np.log1p(-rate)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def unpack(votes: pd.Series, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(votes), np.uint8).reshape(len(votes), -1), axis=1)[:, :n] if len(votes) else np.zeros((0, n), np.uint8)


def _sums(patterns: DataFrame, model: LabelModel, n: int, pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts by class of documents (2), of votes (2, n), and of votes of two together (2, n, n): of all pairs,
    or only of a voter and the one it depends on."""
    parent = np.maximum(model.parent, 0)

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, one, two = np.zeros(2), np.zeros((2, n)), np.zeros((2, n, n))
        for batch in batches:
            v = unpack(batch["votes"], n)
            p = model.posterior(v)
            for y, q in ((0, 1 - p), (1, p)):
                q = q * batch["count"].to_numpy()
                total[y] += q.sum()
                one[y] += q @ v
                if pairs:
                    two[y] += (v * q[:, None]).T @ v
                else:
                    two[y, np.arange(n), parent] += q @ (v * v[:, parent])
        at = np.argwhere(np.triu(two.any(axis=0), 1) if pairs else two.any(axis=0)).tolist()
        yield pd.DataFrame([(-1, -1, *total), *((j, -1, *one[:, j]) for j in range(n)), *((j, k, *two[:, j, k]) for j, k in at)], columns=["j", "k", "clean", "toxic"])

    total, one, two = np.zeros(2), np.zeros((2, n)), np.zeros((2, n, n))
    out = patterns.mapInPandas(run, "j int, k int, clean double, toxic double").groupBy("j", "k").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    for r in out.collect():
        into = total if r["j"] < 0 else one[:, r["j"]] if r["k"] < 0 else two[:, r["j"], r["k"]]
        into += (r["clean"], r["toxic"])
        if pairs and r["k"] >= 0:
            two[:, r["k"], r["j"]] = into
    return total, one, two


def dependence_tree(total: np.ndarray, one: np.ndarray, two: np.ndarray, least: float = 30.0) -> np.ndarray:
    """For each voter the one it depends on, or -1: a forest of the pairs with the most mutual information given the
    class. Pairs whose information times twice the documents is below ``least`` are taken as independent."""
    n = one.shape[1]
    information = np.zeros((n, n))
    for y in (0, 1):
        if total[y] < 1:
            continue
        a, b = (one[y] / total[y])[:, None], (one[y] / total[y])[None, :]
        both = two[y] / total[y]
        for joint, alone in ((both, a * b), (a - both, a * (1 - b)), (b - both, (1 - a) * b), (1 - a - b + both, (1 - a) * (1 - b))):
            real = (joint > 1e-12) & (alone > 1e-12)
            information += total[y] * np.where(real, joint * np.log(np.where(real, joint, 1.0) / np.where(real, alone, 1.0)), 0.0)
    information[~two.any(axis=0)] = 0.0
    j, k = np.nonzero(np.triu(2 * information >= least, 1))
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    linked: list[list[int]] = [[] for _ in range(n)]
    for at in np.argsort(-information[j, k], kind="stable").tolist():
        x, y = int(j[at]), int(k[at])
        if find(x) != find(y):
            root[find(x)] = find(y)
            linked[x].append(y)
            linked[y].append(x)
    parent, seen = np.full(n, -1), set()
    for start in range(n):
        waiting = [] if start in seen else [start]
        seen.add(start)
        while waiting:
            x = waiting.pop()
            for y in linked[x]:
                if y not in seen:
                    seen.add(y)
                    parent[y] = x
                    waiting.append(y)
    return parent


def _estimated(parent: np.ndarray, start: np.ndarray, total: np.ndarray, one: np.ndarray, two: np.ndarray, strength: float, within: float = 5.0) -> LabelModel:
    """The model that fits expected counts; rates lean on the labelled ones as on ``strength`` documents, and rates given
    another's vote lean on the voter's own as on ``within``."""
    alone = np.clip((one + strength * start) / (total[:, None] + strength), 1e-6, 1 - 1e-6)
    rates, held = np.stack([alone, alone], axis=1), parent >= 0
    of = np.maximum(parent, 0)
    both = two[:, np.arange(len(parent)), of]
    for vote, votes_of_parent, together in ((1, one[:, of], both), (0, total[:, None] - one[:, of], one - both)):
        rates[:, vote] = np.where(held, (np.maximum(together, 0) + within * alone) / (np.maximum(votes_of_parent, 0) + within), alone)
    prior = float(np.clip((total[1] + 1) / (total.sum() + 10), 1e-3, 0.9))
    return LabelModel(prior, parent, np.clip(rates, 1e-6, 1 - 1e-6))


def _first_model(start: np.ndarray, total: np.ndarray, one: np.ndarray, two: np.ndarray, close: float = 0.5) -> LabelModel:
    """The model before any class is known: a tree of the voters that go together in all documents. One that mostly votes
    as the one it depends on says nothing of the class beside it; the others start from their own rates."""
    n, total, one, two = one.shape[1], total.sum(), one.sum(axis=0), two.sum(axis=0)
    parent = dependence_tree(np.array([total, 0.0]), np.vstack([one, np.zeros(n)]), np.stack([two, np.zeros((n, n))]))
    of, rates = np.maximum(parent, 0), np.stack([start, start], axis=1)
    both, a, b = two[np.arange(n), of], one, one[of]
    spread = np.sqrt(np.maximum(a * (total - a) * b * (total - b), 1e-9))
    repeats = (parent >= 0) & ((total * both - a * b) / spread > close)
    for vote, given in ((1, (both + 0.5) / (b + 1)), (0, (a - both + 0.5) / (total - b + 1))):
        rates[:, vote] = np.where(repeats, given, rates[:, vote])
    return LabelModel(0.1, parent, rates)


def fit_label_model(patterns: DataFrame, seen: np.ndarray, labels: np.ndarray, n: int, rounds: int = 6, tree_rounds: int = 3, correlated: bool = True) -> LabelModel:
    """Expectation maximisation over all vote patterns, started and steadied by labelled votes (may be none).

    It begins with the tree of voters that go together at all, else voters that repeat each other would be taken for the
    class; then the tree is made anew from what goes together within the classes. ``correlated`` False leaves voters
    independent.
    """
    strength = 200.0
    start = np.vstack([np.full(n, 0.01), np.full(n, 0.2)])
    for y in (0, 1):
        if (labels == y).any():
            own = seen[labels == y]
            start[y] = (own.sum(axis=0) + start[y]) / (len(own) + 1)
    start = np.clip(start, 1e-4, 1 - 1e-4)
    model = LabelModel(0.1, np.full(n, -1), np.stack([start, start], axis=1))
    if correlated:
        model = _first_model(start, *_sums(patterns, model, n, pairs=True))
    for _ in range(rounds):
        model = _estimated(model.parent, start, *_sums(patterns, model, n, pairs=False), strength)
    if correlated:
        sums = _sums(patterns, model, n, pairs=True)
        model = _estimated(dependence_tree(*sums), start, *sums, strength)
        for _ in range(tree_rounds):
            model = _estimated(model.parent, start, *_sums(patterns, model, n, pairs=False), strength)
    return model


def features(votes: np.ndarray, hits: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.column_stack([votes, np.log1p(hits), np.minimum(1.0, 50.0 * hits / np.maximum(n_words, 1)), np.ones(len(votes))]).astype(float)


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 0.5, rounds: int = 25) -> np.ndarray:
    """Newton steps for soft targets of weighted rows; the last column is the bias."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (weight * (target - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = 4000, fit_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null and empty texts get the score of a text without votes. Rows with a null id count as held out. Repeated rows
    pass through; other columns are not read. Without labels the lexicon alone starts the label model and the classifier
    is not calibrated.
    """
    sample = cut(labelled_sample(docs, labels, sample_rows), "toxicity-sample")
    voters = Voters([*LEXICON, *induced_terms(sample, set(LEXICON))])
    n = len(voters.names)
    cast = cut(cast_votes(docs, voters), "toxicity-votes")
    patterns = cut(cast.groupBy("votes").agg(F.count("*").alias("count")), "toxicity-patterns")
    known = cast_votes(sample, voters, "toxic").toPandas()
    seen, truth = unpack(known["votes"], n), known["toxic"].to_numpy(float)
    model = fit_label_model(patterns, seen, truth, n)
    # Rows of all documents by a hash of the id: about fit_rows of them, or all.
    total = cast.count()
    taken = cast if total <= fit_rows else cast.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(fit_rows / total * (1 << 30)))
    some = taken.select("votes", "hits", "n_words").groupBy("votes", "hits", "n_words").agg(F.count("*").alias("count")).toPandas()
    weights = scale = None
    if len(some):
        votes = unpack(some["votes"], n)
        weights = fit_logistic(features(votes, some["hits"].to_numpy(), some["n_words"].to_numpy()), model.posterior(votes), some["count"].to_numpy(float))
        scale = np.array([1.0, 0.0])
    if weights is not None and len(set(truth)) == 2:
        raw = np.column_stack([features(seen, known["hits"].to_numpy(), known["n_words"].to_numpy()) @ weights, np.ones(len(seen))])
        scale = fit_logistic(raw, truth, class_weights(labels, sample_rows)[truth.astype(int)], ridge=0.01)
        scale[0] = max(scale[0], 1e-3)

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = unpack(batch["votes"], n)
            z = scale[0] * (features(v, batch["hits"].to_numpy(), batch["n_words"].to_numpy()) @ weights) + scale[1]
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": score, "predicted": (score >= threshold).astype("int32")})

    if weights is None:  # no documents
        return cast.select("doc_id", held_out().alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    scored = cast.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, score double, predicted int")
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), "score", "predicted").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
