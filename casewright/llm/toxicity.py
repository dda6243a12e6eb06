"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insults (patterns learned from labelled documents), verbs of harm, of intention and of
reported speech in all their forms, targets and negations (fixed lists). One small transducer reads threats as
clauses (intention, harm, whom it strikes), others mark each kind of context, and their composition turns a clause
into a bag of marked matches, such as an insult aimed at somebody, an intended threat, or one that is only
reported. A match weighs by its kind, and by its contexts: a target adds to it, a negation or a report takes away.
How much is fitted on labelled documents from stated weights that hold where the labels tell nothing, and no fit turns
their signs. A document's score is the logistic function of its clauses' matches. Words outside a matched clause count
for nothing.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch



def inflected(verbs: str) -> list[str]:
    """The regular English forms of each verb."""
    stems = [(v, v.removesuffix("e")) for v in verbs.split()]
    return [x for v, stem in stems for x in (v, f"{v}s", f"{stem}ed", f"{stem}ing")]


#: Closed classes of English, German, French and Spanish, and the forms of some verbs.
TARGETS = "you your yours he him she her they them this that these those we us du dich dir ihr euch sie er tu te toi vous il elle ils usted ustedes tú ellos ellas".split()
NEGATIONS = "not no never none without isn't aren't don't nicht kein keine nie pas jamais aucun nunca jamás ningún sin".split()
REPORTING = inflected("report claim quote call say write tell state") + "said told wrote written sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()
THREATS = inflected("kill hurt destroy murder beat threaten attack stab crush strangle") + "stabbed shoot shoots shot shooting töten töte tötet verletzen verletze verletzt zerstören zerstöre zerstört tuer tue tuerai blesser blesse détruire détruis matar mato mataré herir hiero heriré destruir destruyo destruiré".split()
INTENTIONS = "will shall gonna going i'll we'll he'll she'll they'll want wants wanted werde werden wird wollen will vais va allons vont veux voy vamos van quiero".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, INTENT = "ITYNROW"
#: What the threat transducer makes of an intended threat, and of the target that a threat strikes.
INTENDED, STRUCK = "FZ"
MATCHES = (INSULT, THREAT, INTENDED, STRUCK)
#: Clauses end at these characters.
CLAUSE_END = re.compile(r"[.!?;:,\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

#: Bound of what is fitted: labelled documents of the training fold, chosen by a hash of their ids.
TRAINING_ROWS = 20_000
MIN_TOXIC_DOCS = 4
MIN_PRECISION = 0.5
#: A pattern must be this unlikely by chance, over all patterns that were looked at.
CHANCE = 1e-3
PREFIXES = range(4, 11)


@dataclass
class Transducer:
    """Deterministic, over symbols: (state, symbol) -> (state, output); absent arcs lead on by `default` and keep the symbol."""

    arcs: dict = field(default_factory=dict)
    default: dict = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol):
        found = self.arcs.get((state, symbol))
        return found if found else (self.default.get(state, state), symbol)

    def compose(self, then: Transducer, alphabet) -> Transducer:
        """The transducer that feeds this one's output to `then`, with every arc of a reachable state pair."""
        out, todo = Transducer(start=(self.start, then.start)), [(self.start, then.start)]
        seen = set(todo)
        while todo:
            a, b = todo.pop()
            for symbol in alphabet:
                a2, mid = self.step(a, symbol)
                b2, last = then.step(b, mid)
                out.arcs[((a, b), symbol)] = ((a2, b2), last)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return out


def threats(reach: int = 3) -> Transducer:
    """A harm verb within `reach` words after an intention is an intended threat; the first target as near behind a harm verb is struck by it."""
    fst = Transducer(start=(0, 0))
    for intent, harm in product(range(reach + 1), repeat=2):
        after = (max(intent - 1, 0), max(harm - 1, 0))
        fst.default[(intent, harm)] = after
        fst.arcs[((intent, harm), INTENT)] = ((reach, after[1]), OTHER)
        fst.arcs[((intent, harm), THREAT)] = ((after[0], reach), INTENDED if intent else THREAT)
        fst.arcs[((intent, harm), TARGET)] = ((after[0], 0), STRUCK if harm else TARGET)
    return fst


def scope(openers: str, mark: str, length: int | None) -> Transducer:
    """Marks matches after an opener, for `length` further words or to the clause's end; a mark is appended to the symbol."""
    fst, inside = Transducer(), 1 if length is None else length
    marked = ["".join((x, *m)) for x in MATCHES for m in product(*(("", y) for y in "ynr"))]
    for state in range(inside + 1):
        after = state if length is None else max(state - 1, 0)
        fst.default[state] = after
        if state:
            fst.arcs |= {(state, x): (after, x + mark) for x in marked}
        for opener in openers:  # a struck target is a match and an opener, with whatever marks it has
            for x in [opener] + [m for m in marked if m[0] == opener != m]:
                fst.arcs[(state, x)] = (inside, x + mark if state and x in marked else x)
    return fst


def grammar() -> Transducer:
    """Threats, targets within four words, negations within three, reported speech to the clause's end, composed in this order."""
    alphabet = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, INTENT)
    targets = threats().compose(scope(TARGET + STRUCK, "y", 4), alphabet)
    return targets.compose(scope(NEGATION, "n", 3), alphabet).compose(scope(REPORT, "r", None), alphabet)


#: What the grammar can put out for a match: its kind, then the marks of its contexts.
MARKS = ["".join((x, *m)) for x in MATCHES for m in product(("", "y"), ("", "n"), ("", "r"))]
#: What a score adds up: log(1 + the weight of all matches) of each kind, and of those in each context, with the weight
#: that holds without evidence, and the least and the most that a fit may make of it.
FEATURES = {
    INSULT: (2.0, 0.3, 20.0), THREAT: (0.5, 0.3, 20.0), INTENDED: (6.0, 0.3, 20.0), STRUCK: (4.0, 0.3, 20.0),
    "y": (0.5, 0.3, 20.0), "n": (-1.0, -20.0, -0.3), "r": (-1.0, -20.0, -0.3),
}


@dataclass
class Model:
    """patterns: word beginnings (or whole words, ending in `$`) and their weights; weights: one for each of FEATURES, and the bias."""

    patterns: dict
    weights: list
    bias: float


class Matcher:
    """sums(text): the summed weights of the matches with each of MARKS; features(text): what FEATURES make of them."""

    def __init__(self, patterns: dict[str, float]):
        import ahocorasick

        self.patterns, self.fst = patterns, grammar()
        self.sizes = sorted({len(p) - p.endswith("$") for p in patterns})
        self.fixed = {w: s for words, s in ((INTENTIONS, INTENT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTING, REPORT), (THREATS, THREAT)) for w in words}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in {p.rstrip("$") for p in patterns} | set(THREATS):
            self.automaton.add_word(p)
        self.automaton.make_automaton()

    def _insult(self, word: str) -> float:
        found = [self.patterns[p] for n in self.sizes if n <= len(word) and (p := word[:n]) in self.patterns]
        whole = self.patterns.get(word + "$")
        return max([*found, whole] if whole else found, default=0.0)

    def features(self, text: str | None) -> list[float]:
        sums = self.sums(text)
        return [math.log1p(sum(v for m, v in sums.items() if f in m)) for f in FEATURES]

    def sums(self, text: str | None) -> dict[str, float]:
        sums = dict.fromkeys(MARKS, 0.0)
        text, done, begin = (text or "").lower(), 0, 0
        ends = CLAUSE_END.finditer(text)
        end = next(ends, None)
        for last, size in self.automaton.iter(text):
            start = last - size + 1
            if start < done or (start and text[start - 1].isalpha()):
                continue
            while end and end.end() <= start:  # the clause's own beginning, however far back
                begin, end = end.end(), next(ends, None)
            done = end.start() if end else len(text)
            self._clause(text[begin:done], sums)
        return sums

    def _clause(self, clause: str, sums: dict) -> None:
        state, weight = self.fst.start, 1.0
        for word in WORD.findall(clause):
            symbol = self.fixed.get(word, OTHER)
            weight = 1.0
            if symbol == OTHER and (found := self._insult(word)):
                symbol, weight = INSULT, found
            state, out = self.fst.arcs[(state, symbol)]
            if out in sums:
                sums[out] += weight


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _prefixes(docs: DataFrame) -> DataFrame:
    """p: each distinct word's beginnings and, with a `$`, itself; once a row.

    In order, words with the same beginning stand together, so a word tells only those that the one before it lacks.
    """
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= PREFIXES[0])))
    rows = docs.select(words.alias("words")).select(F.explode(F.transform("words", lambda w, i: F.struct(w.alias("w"), F.get("words", i - 1).alias("before")))).alias("x")).select("x.*")
    new = lambda n: (F.length("w") >= n) & ~F.coalesce(F.substring("before", 1, n) == F.substring("w", 1, n), F.lit(False))
    starts = F.array(*(F.when(new(n), F.substring("w", 1, n)) for n in PREFIXES), F.concat("w", F.lit("$")))
    return rows.select(F.explode(F.filter(starts, lambda p: p.isNotNull())).alias("p"))


def by_chance(t, o, rate: float):
    """Bound of the logarithm of the chance that of t + o documents, each toxic at `rate`, t or more are."""
    import numpy as np

    t, n = np.asarray(t, float), np.asarray(t, float) + np.asarray(o, float)
    share = t / n
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0.0)
        return np.where(share > rate, -n * (share * np.log(share / rate) + left), 0.0)


def learn_patterns(training: DataFrame) -> dict[str, float]:
    """Word patterns that mark toxic documents, of training rows (row, text, toxic) of bounded number.

    Candidates come from toxic documents alone; then the others' are counted. Those stay that are mostly toxic, and more
    often than chance would have any candidate be; a pattern weighs by how much likelier it makes its document. It yields to a longer one that holds
    nearly all of its documents, and covers the rest. The training rows bound all of these.
    """
    import numpy as np

    n_toxic, n_rows = training.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    scratch = Scratch(training.sparkSession, "patterns")
    every = scratch.put(_prefixes(training.where("toxic = 1")).groupBy("p").agg(F.count("*").alias("t")))
    n_looked = every.count()
    toxic = every.where(F.col("t") >= MIN_TOXIC_DOCS)
    other = _prefixes(training.where("toxic = 0")).join(toxic.select("p"), "p", "left_semi").groupBy("p").agg(F.count("*").alias("o"))
    rows = toxic.join(other, "p", "left").na.fill(0, ["o"]).where(F.col("t") >= MIN_PRECISION * (F.col("t") + F.col("o"))).collect()
    scratch.drop(every)
    unlikely = by_chance([r.t for r in rows], [r.o for r in rows], n_toxic / max(1, n_rows)) + np.log(max(1, n_looked)) < math.log(CHANCE)
    counts = {r.p: (r.t, r.o) for r, yes in zip(rows, unlikely) if yes}
    longer: dict[str, int] = {}  # toxic documents of the commonest pattern that is longer by one
    for p, (t, _) in counts.items():
        longer[p[:-1]] = max(t, longer.get(p[:-1], 0))
    chosen: dict[str, float] = {}
    for p in sorted(counts, key=lambda p: (len(p.rstrip("$")), p.endswith("$"), p)):
        stem, (t, o) = p.rstrip("$"), counts[p]
        if not any(stem[:n] in chosen for n in PREFIXES if n <= len(stem)) and longer.get(p, 0) < 0.95 * t:
            chosen[p] = max(0.1, math.log((t + 0.5) / (n_toxic + 1) * (n_rows - n_toxic + 1) / (o + 0.5)))
    return chosen


def fit_weights(x, y, ridge: float = 0.1, rounds: int = 100):
    """Logistic regression of FEATURES, by Newton steps from their stated weights and within their bounds; gives weights and bias."""
    import numpy as np

    x = np.hstack([np.asarray(x, float).reshape(-1, len(FEATURES)), np.ones((len(y), 1))])
    prior, least, most = (np.array(v) for v in zip(*FEATURES.values(), (0.0, -30.0, 30.0)))
    penalty = np.r_[np.full(len(FEATURES), ridge), 1e-3]
    y, w = np.asarray(y, float), prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty * (w - prior)
        free = ~((w <= least) & (slope < 0) | (w >= most) & (slope > 0))
        bend = ((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty))[np.ix_(free, free)]
        step = np.zeros(len(w))
        step[free] = np.clip(np.linalg.solve(bend, slope[free]), -1, 1)
        before, w = w, np.clip(w + step, least, most)
        if abs(w - before).max() < 1e-6:
            break
    return w[:-1].tolist(), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", training_rows: int = TRAINING_ROWS) -> Model:
    """Fits patterns and weights on at most `training_rows` labelled documents outside the held-out fold.

    Which ones is told by a hash of their ids. Rows without a label or an id are left out, and labels other
    than 0 and 1; with none left, the model has no patterns and gives every document the score 0.
    """
    sample = labels.select(F.col("doc_id").alias("row"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("row").isNotNull() & ~held_out(F.col("row"))).groupBy("row").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("row"), "row").limit(training_rows)
    # At most training_rows pairs of an id and a label, so the broadcast is bounded, and the texts don't move.
    scratch = Scratch(docs.sparkSession, "toxicity")
    training = scratch.put(docs.select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "row"))
    patterns = learn_patterns(training)
    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("toxic", T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        matcher = Matcher(patterns)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([matcher.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.field("element", pa.float64()))), batch.column(1)], names=["x", "toxic"])

    rows = training.select("text", "toxic").mapInArrow(run, schema).groupBy("x", "toxic").count().collect()
    scratch.drop(training)
    x, y = [r.x for r in rows for _ in range(r["count"])], [r.toxic for r in rows for _ in range(r["count"])]  # at most training_rows
    if not y or not any(y):
        return Model({}, [0.0] * len(FEATURES), -30.0)
    weights, bias = fit_weights(x, y)
    return Model(patterns, weights, bias)


def _scores(model: Model, matcher: Matcher, texts) -> list[float]:
    if not model.patterns:
        return [0.0] * len(texts)
    sums = (model.bias + sum(w * f for w, f in zip(model.weights, matcher.features(t.as_py()))) for t in texts)
    return [1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) for z in sums]


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) of every whole text; one row for each row.

    Only the text counts. A null or empty text, like any without a match, has the bias's score. Other columns
    aren't read; an empty table gives no rows. No shuffle.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        matcher = Matcher(model.patterns)
        for batch in batches:
            scores = _scores(model, matcher, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def keep_documents(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that the model doesn't predict as toxic."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        matcher = Matcher(model.patterns)
        for batch in batches:
            yield batch.filter(pa.array([s < 0.5 for s in _scores(model, matcher, batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
