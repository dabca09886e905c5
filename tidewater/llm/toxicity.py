"""Toxicity: voters, a generative label model of their accuracies and correlations, a linear classifier on its posteriors."""

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewater.llm.common import documents, fold, labelled, rows_of, stored, table
from tidewater.llm.quality import logistic

#: Labelled rows to learn from, at most.
LABELLED = 20_000
#: Features of the classifier, and mined voters with the stems of each.
FEATURES, MINED, STEMS = 3_000, 6, 12
#: Voters whose votes depend on each other given the label are paired from this correlation on.
CORRELATED = 0.15
#: A share of a text's words is counted in units of 1 / UNIT, over EASE more words than there are: one hit says little in a short text.
UNIT, EASE, MOST = 60, 100, 3.0
#: The share (in units) from which a voter says toxic.
VOTES_FROM = 0.5
#: Bounds of the rate at which clean and toxic rows are labelled toxic, and the t from which a feature tells the labels apart.
GIVEN, TELLING = ((0.001, 0.03), (0.85, 0.999)), 4.0
#: Weight of all rows without a label in the label model, as a share of that of the labelled ones, at most: else the classes that EM finds drift from the labels to languages.
LATENT = 0.25
#: Penalty of the classifier's squared weights.
REGULAR = 2e-4

#: Lexicons of common insults, one voter each.
LEXICONS = {
    "mind": "idiot idiots idiotic moron morons moronic stupid stupidity dumb imbecile fool foolish brainless retard",
    "worth": "worthless pathetic loser losers useless failure nobody miserable",
    "filth": "trash garbage scum filth filthy disgusting vermin pig pigs rat rats dirt",
    "mockery": "clown clowns joke laughable ridiculous freak weirdo creep ugly",
    "threat": "kill die hate hurt destroy beat shut",
    "vulgar": "damn crap bastard bitch ass asshole shit shitty fuck fucking",
    "french": "idiot idiote imbécile crétin débile nul minable ordure salaud connard merde dégueulasse",
    "german": "idiot dumm dummkopf trottel versager abschaum dreck arschloch scheiße widerlich wertlos",
    "spanish": "idiota imbécil estúpido estúpida tonto basura escoria perdedor asqueroso inútil mierda",
}
LEXICON_SETS = {k: frozenset(v.split()) for k, v in LEXICONS.items()}
ANY_INSULT = frozenset().union(*LEXICON_SETS.values())
PATTERNS = ("several", "aimed")
AIMED = re.compile(r"\b(?:you|your|they|this|such an?) (?:are |re |is |all |just |an? |such )*(?:" + "|".join(sorted(ANY_INSULT)) + r")\b")
#: ASCII characters other than letters, and how many characters of a word's start stand for it beside the word itself.
_SPACES = bytes(c if chr(c).isalpha() or c >= 0x80 else 0x20 for c in range(256))
HEADS = (3, 4, 5, 6, 7)


def words_of(text: str) -> Counter[str]:
    """How often each word occurs, in lower case, split at all ASCII characters but letters."""
    return Counter(text.lower().encode("utf-8", "replace").translate(_SPACES).decode().split())


def share(hits: int, words: int) -> float:
    """Share of a text's words in units of 1 / UNIT, at most MOST."""
    return min(MOST, UNIT * hits / (words + EASE))


def forms_of(word: str) -> list[str]:
    """A word, and its starts (marked -) where it is longer."""
    return [word, *(word[:k] + "-" for k in HEADS if k < len(word))]


class Wanted:
    """Some features, so that others needn't be made: most words are told from them by their first characters."""

    def __init__(self, features: Iterable[str]) -> None:
        self.features = frozenset(features)
        self.starts = frozenset(f.rstrip("-")[: HEADS[0]] for f in self.features)

    def of(self, word: str) -> list[str]:
        if word[: HEADS[0]] not in self.starts:
            return []
        return [f for f in forms_of(word) if f in self.features]

    def counts(self, words: Counter[str]) -> Counter[str]:
        found: Counter[str] = Counter()
        starts = self.starts
        for word, n in words.items():
            if word[:3] in starts:
                for f in self.of(word):
                    found[f] += n
        return found


def lexicon_shares(words: Counter[str], total: int) -> list[float]:
    """The share of each lexicon's words."""
    hits = ANY_INSULT.intersection(words)
    return [share(sum(words[w] for w in hits & s), total) if hits else 0.0 for s in LEXICON_SETS.values()]


def votes_of(text: str, words: Counter[str], total: int, mined: list[frozenset[str]], wanted: Wanted) -> int:
    """One bit for each voter that says toxic: lexicons, patterns, then the mined lexicons."""
    own = lexicon_shares(words, total)
    votes = [x >= VOTES_FROM for x in own]
    votes += [share(len(ANY_INSULT.intersection(words)), total) >= 2 * VOTES_FROM, bool(any(votes) and AIMED.search(text.lower()))]
    hits = [0] * len(mined)
    for word, n in words.items():
        if word[:3] in wanted.starts:
            found = wanted.of(word)
            for k, m in enumerate(mined) if found else ():
                if not m.isdisjoint(found):
                    hits[k] += n
    votes += [share(h, total) >= VOTES_FROM for h in hits]
    return sum(1 << i for i, v in enumerate(votes) if v)


@dataclass
class LabelModel:
    """P(label) and, for each voter, P(vote | label, vote of the voter it depends on); a given label is one more vote, of an accuracy of its own."""

    n: int
    prior: float = 0.1
    parent: list[int] = field(default_factory=list)
    rate: np.ndarray | None = None  # [label, voter, vote of the parent]
    given: np.ndarray = field(default_factory=lambda: np.array([0.02, 0.95]))  # P(given label is 1 | label)

    def _log_odds(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        out = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for v in range(self.n):
            p = self.rate[:, v, :][:, self._above(votes, v)]
            p = np.where(votes[:, v] == 1, p, 1 - p)
            out += np.where(votes[:, v] >= 0, np.log(p[1]) - np.log(p[0]), 0.0)
        p = np.where(labels == 1, self.given[:, None], 1 - self.given[:, None])
        return out + np.where(labels >= 0, np.log(p[1]) - np.log(p[0]), 0.0)

    def _above(self, votes: np.ndarray, v: int) -> np.ndarray:
        return np.maximum(votes[:, self.parent[v]], 0) if self.parent[v] >= 0 else np.zeros(len(votes), int)

    def posterior(self, patterns: np.ndarray, labels: np.ndarray | None = None, silent: np.ndarray | None = None) -> np.ndarray:
        """P(toxic) of vote patterns; labels of -1 aren't given; silent marks, as bits, voters that don't count for a row."""
        labels = np.full(len(patterns), -1) if labels is None else labels
        return 1 / (1 + np.exp(-self._log_odds(self.bits(patterns, silent), labels)))

    def bits(self, patterns: np.ndarray, silent: np.ndarray | None = None) -> np.ndarray:
        votes = (np.asarray(patterns, np.int64)[:, None] >> np.arange(self.n)) & 1
        return votes if silent is None else np.where((np.asarray(silent, np.int64)[:, None] >> np.arange(self.n)) & 1, -1, votes)

    def fit(self, patterns: np.ndarray, labels: np.ndarray, weights: np.ndarray, silent: np.ndarray | None = None, steps: int = 40) -> "LabelModel":
        """EM over vote patterns. Correlations come from a first fit without them."""
        votes = self.bits(patterns, silent)
        start = np.where(labels >= 0, self.given[np.maximum(labels, 0)], np.where((votes > 0).any(axis=1), 0.7, 0.02)).astype(float)
        self.parent = [-1] * self.n
        q = self._em(votes, labels, weights, start, steps)
        pairs = []
        for y in (q, 1 - q):  # correlation of the votes within each label
            w = weights * y * (votes >= 0).all(axis=1)
            total = max(w.sum(), 1e-9)
            mean = (w @ votes) / total
            cov = (votes * w[:, None]).T @ votes / total - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
            pairs.append(np.abs(cov / np.outer(sd, sd)) * min(1, total / 50))
        strength = np.triu(np.maximum(*pairs), 1)
        tree = list(range(self.n))
        for at in np.argsort(-strength, axis=None):  # strongest first; each voter depends on at most one other
            i, j = divmod(int(at), self.n)
            if strength[i, j] < CORRELATED:
                break
            if tree[i] != tree[j] and self.parent[j] < 0:
                self.parent[j] = i
                tree = [tree[i] if t == tree[j] else t for t in tree]
        self._em(votes, labels, weights, q, steps)
        return self

    def _em(self, votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, q: np.ndarray, steps: int) -> np.ndarray:
        for _ in range(steps):
            self.prior = float(np.clip((weights @ q) / max(weights.sum(), 1e-9), 1e-4, 0.9))
            rate, known = np.empty((2, self.n, 2)), labels >= 0
            for label, w in ((1, weights * q), (0, weights * (1 - q))):
                for v in range(self.n):
                    above, cast = self._above(votes, v), w * (votes[:, v] >= 0)
                    overall = (cast @ (votes[:, v] == 1) + 0.5) / (cast.sum() + 1)
                    for a in (0, 1):
                        w_a = cast * (above == a)
                        rate[label, v, a] = (w_a @ (votes[:, v] == 1) + 2 * overall) / (w_a.sum() + 2)
                told = ((w * known) @ (labels == 1) + 0.5) / ((w * known).sum() + 1)
                self.given[label] = np.clip(told, *GIVEN[label])
            self.rate = np.clip(rate, 1e-5, 1 - 1e-5)
            q = 1 / (1 + np.exp(-self._log_odds(votes, labels)))
        return q


@dataclass
class ToxicityModel:
    mined: list[frozenset[str]]
    label_model: LabelModel
    vocabulary: list[str]
    weights: np.ndarray  # of the vocabulary, then of lexicon_shares
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.wanted, self.at = Wanted(self.vocabulary), {f: i for i, f in enumerate(self.vocabulary)}

    def inputs(self, text: str) -> tuple[list[int], list[float]]:
        """The places and values other than 0 of the classifier's inputs, in ascending order."""
        words = words_of(text)
        total = words.total()
        found = sorted((self.at[f], share(n, total)) for f, n in self.wanted.counts(words).items())
        found += [(len(self.vocabulary) + i, x) for i, x in enumerate(lexicon_shares(words, total)) if x]
        return [i for i, _ in found], [x for _, x in found]

    def margin(self, text: str) -> float:
        at, x = self.inputs(text)
        return self.intercept + float(self.weights[at] @ np.array(x)) if at else self.intercept

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.shift, -30, 30))))


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch, texts in rows_of(batches):
        yield batch, [(t or b"").decode() for t in texts]


def _vote_frame(texts: DataFrame, mined: list[frozenset[str]], keep: str = "") -> DataFrame:
    """The pattern of the votes of each text, with the columns in keep."""
    names, wanted = [x.split()[0] for x in keep.split(", ") if x], Wanted(frozenset().union(*mined))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in _texts_of(batches):
            patterns = [votes_of(t, w, w.total(), mined, wanted) for t, w in ((t, words_of(t)) for t in bodies)]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in names} | {"pattern": pa.array(patterns, pa.int64())})

    return texts.mapInArrow(vote, ", ".join([*filter(None, [keep]), "pattern long"]))


def _count(sample: DataFrame) -> DataFrame:
    """f, n, and for each half and label the sum and the sum of squares of the shares of each feature in the sample (columns text, half, label)."""
    kinds = [f"{x}{half}{label}" for half in (0, 1) for label in (0, 1) for x in "sq"]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts_of(batches):
            kind_of = 2 * batch.column("half").to_numpy() + batch.column("label").to_numpy()
            counted, words, features = [words_of(t) for t in texts], {}, {}
            word = np.array([words.setdefault(w, len(words)) for c in counted for w in c], int)
            n, size = np.array([x for c in counted for x in c.values()], int), np.array([c.total() for c in counted])
            forms = [[features.setdefault(f, len(features)) for f in forms_of(w)] for w in words]
            length, form = np.array([len(f) for f in forms], int), np.array(list(chain.from_iterable(forms)), int)
            # a row for each form of each word of each text, then one for each form and text
            times = length[word]
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat((np.cumsum(length) - length)[word], times)
            text = np.repeat(np.repeat(np.arange(len(counted)), [len(c) for c in counted]), times)
            key, at = np.unique(form[place] * len(counted) + text, return_inverse=True)
            f, text = np.divmod(key, max(1, len(counted)))
            x = np.minimum(MOST, UNIT * np.bincount(at, np.repeat(n, times)) / (size[text] + EASE)) if len(key) else np.zeros(0)
            out = {"f": pa.array(list(features), pa.string()), "n": pa.array(np.bincount(f, minlength=len(features)).astype(np.int64))}
            for k, name in enumerate(kinds):
                out[name] = pa.array(np.bincount(f, x ** (1 + k % 2) * (kind_of[text] == k // 2), len(features)))
            yield pa.RecordBatch.from_pydict(out)

    sums = [F.sum(k).alias(k) for k in ("n", *kinds)]
    return sample.mapInArrow(explode, "f string, n long, " + ", ".join(f"{k} double" for k in kinds)).groupBy("f").agg(*sums).where("n >= 3")


def _telling(counts: DataFrame, sizes: dict[tuple[int, int], int], halves: tuple[int, ...], bound: int) -> list[tuple[str, float]]:
    """The features whose mean share differs most between the labels, by Welch's t."""
    mean, spread = {}, F.lit(1e-9)
    for y in (0, 1):
        n = sum(sizes.get((h, y), 0) for h in halves) + 2.0
        mean[y] = sum((F.col(f"s{h}{y}") for h in halves), F.lit(0.0)) / n
        spread = spread + (sum((F.col(f"q{h}{y}") for h in halves), F.lit(0.02)) / n - mean[y] * mean[y]) / n
    t = (mean[1] - mean[0]) / F.sqrt(spread)
    return [(r[0], r[1]) for r in counts.select("f", t.alias("t")).where(F.abs("t") >= TELLING).orderBy(F.abs("t").desc(), "f").limit(bound).collect()]


def _apart(features: Iterable[str], bound: int) -> list[str]:
    """The first of features that aren't starts of one another."""
    chosen: list[str] = []
    for f in features:
        stem = f.rstrip("-")
        if not any(stem.startswith(c) or c.startswith(stem) for c in (x.rstrip("-") for x in chosen)):
            chosen.append(f)
            if len(chosen) == bound:
                break
    return chosen


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> ToxicityModel:
    """Voters vote on all of docs; a label model of their votes gives posterior labels; a linear classifier learns those.

    At most bound labelled rows outside the held-out fold are learnt from, in five parts by a hash of the id. Two parts mine voters'
    stems, which are silent on those parts; two more tell, with the votes on all documents, how accurate and how
    correlated voters and given labels are. The classifier is trained on the posteriors of these four parts that their votes have: the label
    given to a row is not among them, so votes overrule it. The last part, which nothing else has seen, calibrates its score. With no labels, or those of one kind alone, all scores are low.
    """
    texts = documents(docs)
    chosen = stored(labelled(labels, "toxic", bound))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)).cast("int")
    sample = texts.join(F.broadcast(chosen), "doc_id").select("text", "label", F.floor(part / 2).cast("int").alias("half"))
    sample = stored(sample.repartition(docs.sparkSession.sparkContext.defaultParallelism))  # few rows, much work on each
    learnt = sample.where("half < 2")
    sizes = {(r[0], r[1]): r[2] for r in learnt.groupBy("half", "label").count().collect()}
    counts = stored(_count(learnt))
    toxic = _apart((f for f, t in _telling(counts, sizes, (0,), FEATURES) if t > 0), MINED * STEMS)
    mined = [frozenset(toxic[i::MINED]) for i in range(MINED)]
    n = len(LEXICONS) + len(PATTERNS) + MINED
    votes = {r[0]: r[1] for r in _vote_frame(texts, mined).groupBy("pattern").count().collect()}  # 2 ** n patterns at most
    seen = stored(_vote_frame(learnt, mined, "half int, label int, text string"))
    silent, rows = ((1 << MINED) - 1) << (n - MINED), []
    for p, half, y, c in seen.groupBy("pattern", "half", "label").count().collect():
        votes[p] = votes.get(p, 0) - c
        rows.append((p, y, c, silent if half == 0 else 0))
    rows += [(p, -1, c, 0) for p, c in votes.items() if c > 0]
    model = ToxicityModel(mined, LabelModel(n), [], np.zeros(len(LEXICONS)), -3.0)
    if len({y for _, y, _, _ in rows if y >= 0}) < 2:
        return model
    patterns, ys, ws, hidden = (np.array(x) for x in zip(*rows, strict=True))
    told = ys >= 0
    ws = np.where(told, ws, ws * min(1.0, LATENT * ws[told].sum() / max(1, ws[~told].sum())))
    model.label_model.fit(patterns, ys, ws, hidden)
    p = model.label_model.posterior(patterns, None, hidden)  # of the votes: a given label tells how good voters are, and not what its row is
    soft = [(int(a), int(b == 0), int(y), float(q)) for a, y, b, q in zip(patterns, ys, hidden, p, strict=True) if y >= 0]
    soft = docs.sparkSession.createDataFrame(soft, "pattern long, half int, label int, p double")  # a row for each pattern at most
    train = seen.join(F.broadcast(soft), ["pattern", "half", "label"]).select("text", "p")
    vocabulary = sorted(f for f, _ in _telling(counts, sizes, (0, 1), FEATURES))
    model = ToxicityModel(mined, model.label_model, vocabulary, np.zeros(len(vocabulary) + len(LEXICONS)), 0.0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.weights)
        for batch, bodies in _texts_of(batches):
            at, x = zip(*map(model.inputs, bodies), strict=True) if bodies else ((), ())
            kinds = pa.array([0] * len(at), pa.int8()), pa.array([size] * len(at), pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict({"x": pa.StructArray.from_arrays(kinds, ["type", "size", "indices", "values"]), "p": batch.column("p")})

    train = stored(train.mapInArrow(vectors, StructType([StructField("x", VectorUDT()), StructField("p", DoubleType())])))
    train = train.select("x", F.explode(F.array(F.struct(F.lit(1.0).alias("y"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("p")).alias("w")))).alias("e"))
    train = train.select("x", F.col("e.y").alias("label"), F.col("e.w").alias("weight")).where("weight > 0.001")
    fitted = LogisticRegression(featuresCol="x", weightCol="weight", regParam=REGULAR, maxIter=60, standardization=False).fit(train)
    model.weights, model.intercept = fitted.coefficients.toArray(), float(fitted.intercept)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in _texts_of(batches):
            yield pa.RecordBatch.from_pydict({"z": pa.array([model.margin(t) for t in bodies], pa.float64()), "label": batch.column("label")})

    left = sample.where("half = 2").select("text", "label").mapInArrow(margins, "z double, label int").collect()  # a fifth of bound rows, two numbers each
    if len({r[1] for r in left}) == 2:
        model.shift, model.slope = logistic(np.array([[r[0]] for r in left]), np.array([r[1] for r in left], float), ridge=0.1)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs; the score reads the whole text and nothing else.

    Null and empty texts get the score of a text without words. Null ids count as the text "" in the held-out fold. Repeated
    rows repeat their result; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, texts in _texts_of(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array([own.score(t) for t in texts], pa.float64())})

    scored = documents(docs).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject (score below 0.5), all columns carried.

    Each row is judged by its own text: null and repeated ids don't matter, repeated rows all go or all stay, null texts are judged
    as empty ones, an empty table gives an empty result.
    """
    model = fit_toxicity(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts_of(batches):
            yield batch.filter(pa.array([shared.value.score(t) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
