"""Toxicity: a weighted finite-state grammar over the clauses of a text.

Words are mapped to classes by a lexicon: insults and threats (with weights),
targets, negations, verbs of reported speech, and all others.  Five weighted
transducers read a clause's classes one after the other:

* reporting marks insults and threats after a verb of reported speech,
* negating marks those within reach of a negation,
* aiming marks insults after a target,
* threatening turns a threat and a later target into one symbol,
* weighing emits the weight of each marked insult and threat.

``compose`` joins them to one transducer, state by state.  A clause scores what
it emits; a text is judged by its strongest clause and the number of clauses
that match, through a logistic model.

Insults are learned from labels: words, and word beginnings that several words
share, which are much more frequent in toxic texts of the sample.  The fixed
words below count where the labels say nothing about them.  The weights of the
patterns are fitted too; they are never negative, and a negated or reported
pattern has at most ``DAMPED`` of the plain one.  All is fitted on a hash sample
of about ``SAMPLE_DOCS`` labelled rows, of which copies count once; held-out rows are
never among them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .language import hash_sample
from .language import held_out as crc_part
from .shared import need_columns, small_batches

#: Labelled documents that the model is fitted on, at most about.
SAMPLE_DOCS = 12_000
#: Lengths of word beginnings that can have a weight, and how many different
#: words of toxic texts must share one.
STEMS, SHARED = (4, 5, 6, 7), 3
#: Least log odds, and least share of the toxic sample, of a learned insult.
LEAST_ODDS, LEAST_SHARE, LEAST_DOCS = 3.0, 0.008, 3
#: Learned words and beginnings, at most.
MOST_WORDS = 20_000
#: Weight of a fixed insult or threat where nothing was learned; else they have
#: the median of the learned weights.
FIXED = 4.0
#: Words after a negation that it reaches; the most that is left of a pattern's
#: weight where it is negated or reported.
REACH, DAMPED = 3, 0.25

INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns imbecile fool dumb idiotisch trottel dumm abschaum arschloch imbécile connard débile ordure idiota estúpido imbécil basura escoria".split()
THREATS = "kill kills hurt destroy beat shoot stab burn töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours u he she they them him her his their du dich dir ihr euch sie tu toi vous ton ta usted ustedes tú te ellos ellas".split()
NEGATIONS = "not no never nor isn't aren't wasn't don't doesn't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say wrote writes told claimed called quoted quote according sagte sagt schrieb behauptete nannte dit disait écrit déclare dijo dice escribió llamó según".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = "other", "insult", "threat", "target", "negation", "report", "end"
CLASSES = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END)
#: Marks on insults and threats: reported, negated, aimed.
_R, _N, _A = "/reported", "/negated", "/aimed"
_TOKENS = regex.compile(r"\p{L}+(?:'\p{L}+)?|[.!?;:\n]+")
_ENDS = frozenset(".!?;:\n")
#: What the weighing transducer knows: each has a weight of its own.
PATTERNS = tuple(INSULT + r + n + a for r in ("", _R) for n in ("", _N) for a in ("", _A)) + tuple(THREAT + r + n for r in ("", _R) for n in ("", _N))


class Transducer:
    """A deterministic weighted transducer: arcs from (state, symbol) to (state,
    symbol that is written, weight).  Where a state has no arc for a symbol, the
    symbol is written as it is, without weight, and the state stays."""

    def __init__(self, start: object, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state: object, symbol: str) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def run(self, symbols: Iterable[str]) -> tuple[list[str], float]:
        """What is written, and the sum of the weights."""
        state, out, total = self.start, [], 0.0
        for s in symbols:
            state, o, w = self.step(state, s)
            out.append(o)
            total += w
        return out, total


def compose(a: Transducer, b: Transducer, symbols: Iterable[str] = CLASSES) -> Transducer:
    """The transducer that writes what b writes on what a writes; its states are
    the pairs of states that ``symbols`` reach, and weights add up."""
    symbols = tuple(symbols)
    start, arcs = (a.start, b.start), {}
    todo, seen = [start], {start}
    while todo:
        x, y = todo.pop()
        for s in symbols:
            x2, o, w = a.step(x, s)
            y2, o2, w2 = b.step(y, o)
            arcs[(x, y), s] = (x2, y2), o2, w + w2
            if (x2, y2) not in seen:
                seen.add((x2, y2))
                todo.append((x2, y2))
    return Transducer(start, arcs)


def reporting() -> Transducer:
    arcs = {(0, REPORT): (1, REPORT, 0.0), (1, END): (0, END, 0.0)}
    return Transducer(0, arcs | {(1, k): (1, k + _R, 0.0) for k in (INSULT, THREAT)})


def negating() -> Transducer:
    arcs = {}
    marked = [k + r for k in (INSULT, THREAT) for r in ("", _R)]
    for left in range(REACH + 1):
        rest = max(0, left - 1)
        arcs |= {(left, s): (rest, s, 0.0) for s in (OTHER, TARGET, REPORT)}
        arcs |= {(left, s): (rest, s + _N if left else s, 0.0) for s in marked}
        arcs |= {(left, NEGATION): (REACH, NEGATION, 0.0), (left, END): (0, END, 0.0)}
    return Transducer(0, arcs)


def aiming() -> Transducer:
    arcs = {(0, TARGET): (1, TARGET, 0.0), (1, END): (0, END, 0.0)}
    return Transducer(0, arcs | {(1, INSULT + r + n): (1, INSULT + r + n + _A, 0.0) for r in ("", _R) for n in ("", _N)})


def threatening() -> Transducer:
    """A threat is held back until its target comes; a later one takes its place."""
    held = [THREAT + r + n for r in ("", _R) for n in ("", _N)]
    arcs = {(state, t): (t, OTHER, 0.0) for state in ("", *held) for t in held}
    arcs |= {(t, TARGET): ("", t, 0.0) for t in held}
    return Transducer("", arcs | {(t, END): ("", END, 0.0) for t in held})


def weighing(weights: dict[str, float]) -> Transducer:
    return Transducer(0, {(0, p): (0, p, w) for p, w in weights.items()})


def grammar(weights: dict[str, float]) -> Transducer:
    """All five, composed."""
    out = reporting()
    for machine in (negating(), aiming(), threatening(), weighing(weights)):
        out = compose(out, machine)
    return out


class Lexicon:
    """The class and weight of words."""

    def __init__(self, learned: dict[str, float], beginnings: dict[str, float], judged: set[str]):
        self.learned, self.beginnings, self.judged = learned, beginnings, judged
        fixed = float(np.median([*learned.values(), *beginnings.values()])) if learned or beginnings else FIXED
        self.words: dict[str, tuple[str, float]] = {}
        for words, kind in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT)):
            self.words |= dict.fromkeys(words, (kind, fixed))
        self.words |= {w: (INSULT, fixed) for w in INSULTS if w not in judged}
        self.cache: dict[str, tuple[str, float]] = {}

    def kind(self, word: str) -> tuple[str, float]:
        """The class of a lower-cased word, and its weight."""
        if (known := self.cache.get(word)) is not None:
            return known
        w = max((self.beginnings.get(word[:n], 0.0) for n in STEMS if n <= len(word)), default=0.0)
        w = max(w, self.learned.get(word, 0.0))
        out = (INSULT, w) if w > 0 else self.words.get(word, (OTHER, 0.0))
        if len(self.cache) > 100_000:
            self.cache.clear()
        self.cache[word] = out
        return out

    def clauses(self, text: str | None, machine: Transducer) -> list[dict[str, float]]:
        """For each clause that matches anything: what its patterns hold, the sum
        of their words' weights."""
        words = _TOKENS.findall(text.lower()) if text else []
        if not any(self.kind(w)[0] in (INSULT, THREAT) for w in set(words)):
            return []
        out, now, state, threat = [], {}, machine.start, 0.0
        for w in words:
            kind, weight = (END, 0.0) if w[0] in _ENDS else self.kind(w)
            state, pattern, _ = machine.step(state, kind)
            if kind == THREAT:
                threat = weight
            if pattern in _PATTERN_SET:
                now[pattern] = now.get(pattern, 0.0) + (weight if kind == INSULT else threat)
            if kind == END and now:
                out.append(now)
                now = {}
        return [*out, now] if now else out


_PATTERN_SET = frozenset(PATTERNS)
#: Pattern weights before any label is seen.
PRIOR = {p: (1.0 if p.startswith(THREAT) else 1.25 if p.endswith(_A) else 1.0) * (0.2 if _R in p else 1) * (0.15 if _N in p else 1) for p in PATTERNS}


def plain(pattern: str) -> str:
    """The pattern without its negation and reported speech."""
    return pattern.replace(_R, "").replace(_N, "")


class Model:
    """A lexicon, pattern weights, and the logistic model's base and weight of
    the number of matching clauses."""

    def __init__(self, lexicon: Lexicon, weights: dict[str, float], base: float, many: float):
        self.lexicon, self.weights, self.base, self.many = lexicon, weights, base, many
        self.machine = grammar(weights)

    def parts(self) -> tuple:
        return self.lexicon.learned, self.lexicon.beginnings, self.lexicon.judged, self.weights, self.base, self.many

    @classmethod
    def of(cls, learned, beginnings, judged, weights, base, many) -> Model:
        return cls(Lexicon(learned, beginnings, judged), weights, base, many)

    def clause(self, held: dict[str, float]) -> float:
        return sum(self.weights[p] * x for p, x in held.items())

    def score(self, text: str | None) -> float:
        found = self.lexicon.clauses(text, self.machine)
        z = self.base + (max(map(self.clause, found)) + self.many * math.log(len(found)) if found else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


#: The base and the weight of the number of clauses before any label is seen: a
#: single plain insult is toxic.
BASE, MANY = -3.0, 0.5


def _weights(texts: list[tuple[float, list[dict[str, float]]]]) -> tuple[dict[str, float], float, float]:
    """Pattern weights, base and weight of the number of clauses: logistic
    regression by projected gradient steps, pulled to the prior; each text has
    the clause that is strongest under the weights so far."""
    theta = np.array([PRIOR[p] for p in PATTERNS] + [MANY, BASE])
    prior, at = theta.copy(), {p: i for i, p in enumerate(PATTERNS)}
    base = np.array([at[plain(p)] for p in PATTERNS])
    damped = np.array([plain(p) != p for p in PATTERNS])
    y = np.array([t for t, _ in texts])
    pull = np.array([1.0] * (len(PATTERNS) + 1) + [1e-3]) * 1e-3
    for _ in range(6):
        x = np.zeros((len(texts), len(theta)))
        x[:, -1] = 1
        for i, (_, found) in enumerate(texts):
            if found:
                held = max(found, key=lambda c: sum(theta[at[p]] * v for p, v in c.items()))
                for p, v in held.items():
                    x[i, at[p]] = v
                x[i, -2] = math.log(len(found))
        step = 4.0 / (np.square(x).sum(axis=1).mean() + 1e-9)
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            theta = theta - step * (x.T @ (p - y) / len(y) + pull * (theta - prior))
            theta[:-1] = np.maximum(theta[:-1], 0.0)
            cap = DAMPED * theta[base]
            theta[: len(PATTERNS)] = np.where(damped, np.minimum(theta[: len(PATTERNS)], cap), theta[: len(PATTERNS)])
    return {p: float(theta[i]) for p, i in at.items()}, float(theta[-1]), float(theta[-2])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit lexicon and weights on a bounded sample of labelled rows.

    Where the sample lacks either label, the fixed words and prior weights stay.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~crc_part(0, 5)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = hash_sample(usable, SAMPLE_DOCS, 23)
    texts = docs.select("doc_id", "text").where("text is not null")
    # copies and near copies count once: those with the same least hash of three words
    split = picked.join(texts, "doc_id").withColumn("w", F.split("text", " "))
    least = F.expr("array_min(transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64(w[i], get(w, i + 1), get(w, i + 2))))")
    sample = split.groupBy(least.alias("family"), "toxic").agg(F.min_by("text", "doc_id").alias("text")).select("toxic", "text").persist()
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        sample.unpersist()
        return Model(Lexicon({}, {}, set()), dict(PRIOR), BASE, MANY)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1))
    each = sample.select("toxic", F.monotonically_increasing_id().alias("i"), F.explode(words).alias("word"))
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * bad))
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (good + 1))

    def frequent(rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy(*key).agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).where(f"t >= {least}").withColumn("odds", odds).where(f"odds >= {LEAST_ODDS}")

    whole = frequent(each, "word").where("length(word) >= 3").orderBy(F.desc("odds"), "word").limit(MOST_WORDS).collect()
    cuts = F.explode(F.array(*[F.when(F.length("word") >= n, F.left("word", F.lit(n))) for n in STEMS])).alias("start")
    # toxic texts name the beginnings that may count, then all texts count them
    toxic = each.where("toxic = 1").select("i", "word", cuts).where("start is not null").groupBy("start")
    maybe = toxic.agg(F.countDistinct("i").alias("t"), F.countDistinct("word").alias("k")).where(f"t >= {least} and k >= {SHARED}").select("start")
    starts = each.select("toxic", "i", cuts).where("start is not null").join(maybe, "start", "left_semi")
    start = frequent(starts.distinct(), "start")
    found = {r.start: (r.t, r.odds) for r in start.orderBy(F.desc("odds"), "start").limit(MOST_WORDS).collect()}
    # of beginnings that stand in as many toxic texts, the longest
    longer = {s[:-1]: 0 for s in found}
    for s, (t, _) in found.items():
        longer[s[:-1]] = max(longer.get(s[:-1], 0), t)
    beginnings = {s: min(8.0, o) for s, (t, o) in found.items() if longer.get(s, 0) < 0.95 * t}
    learned = {r.word: min(8.0, r.odds) for r in whole}
    judged = {r.word for r in each.where(F.col("word").isin(INSULTS)).groupBy("word").count().where("count >= 5").collect()}
    shared = docs.sparkSession.sparkContext.broadcast((learned, beginnings, judged))

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, machine = Lexicon(*shared.value), grammar(PRIOR)
        for b in batches:
            found = [json.dumps(lexicon.clauses(t.as_py(), machine)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["toxic", "found"])

    got = sample.select(F.col("toxic").cast("double"), "text").mapInArrow(matches, "toxic double, found string").collect()
    sample.unpersist()
    return Model(Lexicon(learned, beginnings, judged), *_weights([(r.toxic, json.loads(r.found)) for r in sorted(got, key=lambda r: (r.toxic, r.found))]))


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every whole text.

    Null and empty texts have no clause and score the base; repeated rows score
    alike; other columns are not read; an empty table gives no rows.
    """
    need_columns(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(*shared.value)
        for b in batches:
            s = [m.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, unchanged and with all their columns, whose text is
    not predicted to be toxic (a null or empty text is judged by the base)."""
    need_columns(docs, "text")
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.of(*shared.value)
        for b in batches:
            yield b.filter(pa.array([m.score(t.as_py()) < 0.5 for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    return crc_part(0, 5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document for toxicity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
