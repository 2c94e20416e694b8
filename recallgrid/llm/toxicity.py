"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols; five small transducers, each a table of its own, read them:

* insult    emits the weight of an insult word;
* threat    holds the weights of verbs of harm and emits them if a target follows within ``REACH`` words, and emits
            the weight of a verb of harm read after a target and an auxiliary ("you will be killed");
* target    raises what is emitted within ``REACH`` words after a person is addressed;
* negation  lowers what is emitted within ``REACH`` words after a negating word;
* report    lowers what the rest of a sentence emits after a verb of speaking.

``compose`` multiplies them out into one deterministic table. A stop ends everything; a pause (comma, colon) ends
a clause and all but the report, so that "he said: ..." still reports what follows. Quotes change nothing.

A document's evidence is made of the scores of its matched clauses, not of isolated words: sum,
largest, and number. Words of the insult and threat lists are seeds; ``fit`` adds words and stems
that labelled texts show, with log-odds as weights, and a logistic over the evidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import P, Scratch, slices

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, AUXILIARY, HARMED, PAUSE, STOP = range(10)
REACH = 3
#: Fixed word lists of the grammar.
SEED_INSULTS = "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting imbecile filth vermin"
SEED_THREATS = "kill hurt destroy murder beat shoot stab töten schlagen tuer frapper matar golpear"
SEED_HARMED = "killed destroyed murdered beaten shot stabbed getötet geschlagen tué tuée frappé frappée matado golpeado"
TARGETS = "you your yours u he she they them him her those these du dich dir ihr euch sie tu te toi vous ils elles usted ustedes ellos ellas tú ti"
NEGATIONS = "not no never isn't aren't wasn't don't doesn't won't nicht kein keine nie pas jamais aucun nunca ningún ninguna jamás"
REPORTS = "said says called calls quoted wrote claimed alleged sagte nannte schrieb dit disait appelé dijo dice llamó escribió"
AUXILIARIES = "be been being get gets got werden wirst wird werdet être seras serez sera ser serás será"
SEED_WEIGHT = 3.0
TARGET_FACTOR, NEGATED_FACTOR, REPORTED_FACTOR = 1.25, 0.4, 0.6
#: Bound on the labelled rows that a fit reads.
MAX_LABELLED = 8000
#: Share of the toxic texts that a learned word or stem must explain beyond better ones.
LEAST_EXPLAINED = 0.004
STEMS = (4, 5, 6, 7, 8)
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;|\n]+|[:,]+")

#: What a transition emits: nothing, the weight of the word read, or the weights held; and what it does to the latter.
NOTHING, READ, HELD = 0, 1, 2
KEEP, ADD, CLEAR = 0, 1, 2


@dataclass
class Transducer:
    """States 0 to n - 1 (0 first); for each state and symbol the next state, a factor on whatever is emitted there,
    what is emitted, and what happens to held weights."""

    name: str
    step: list[list[int]]
    factor: list[list[float]]
    emit: list[list[int]]
    hold: list[list[int]]

    @classmethod
    def of(cls, name: str, states: int, rule) -> Transducer:
        """A table from ``rule(state, symbol) -> dict`` of what differs from: state 0, factor 1, emit and do nothing."""
        got = [[{"to": 0, "factor": 1.0, "emit": NOTHING, "hold": KEEP} | rule(s, a) for a in range(STOP + 1)] for s in range(states)]
        return cls(name, *([[x[k] for x in row] for row in got] for k in ("to", "factor", "emit", "hold")))


def _fades(state: int, symbol: int) -> int:
    """A reach of words counts down with each word and ends with the clause."""
    return 0 if symbol in (PAUSE, STOP) else max(0, state - 1)


def insult_transducer() -> Transducer:
    return Transducer.of("insult", 1, lambda s, a: {"emit": READ if a == INSULT else NOTHING})


def target_transducer() -> Transducer:
    return Transducer.of("target", REACH + 1, lambda s, a: {"to": REACH if a == TARGET else _fades(s, a), "factor": TARGET_FACTOR if s and a == INSULT else 1.0})


def negation_transducer() -> Transducer:
    return Transducer.of("negation", REACH + 1, lambda s, a: {"to": REACH if a == NEGATION else _fades(s, a), "factor": NEGATED_FACTOR if s else 1.0})


def report_transducer() -> Transducer:
    return Transducer.of("report", 2, lambda s, a: {"to": 0 if a == STOP else 1 if a == REPORT else s, "factor": REPORTED_FACTOR if s else 1.0})


def threat_transducer() -> Transducer:
    """Idle; 1 to REACH: verbs wait for a target so many words; then so many words after a target; then after its auxiliary."""
    waits, seen, ready = range(1, REACH + 1), range(REACH + 1, 2 * REACH + 1), range(2 * REACH + 1, 3 * REACH + 1)

    def rule(s: int, a: int) -> dict:
        fade = 0 if a in (PAUSE, STOP) or s in (0, waits[0], seen[0], ready[0]) else s - 1
        drop = {"hold": CLEAR} if s in waits and fade == 0 else {}
        if a == TARGET:
            return {"to": seen[-1], "emit": HELD if s in waits else NOTHING, "hold": CLEAR}
        if s in ready and a in (THREAT, HARMED):
            return {"to": 0, "emit": READ}
        if a == THREAT:
            return {"to": waits[-1], "hold": ADD}
        if a == AUXILIARY and (s in seen or s in ready):
            return {"to": ready[-1]}
        return {"to": fade} | drop

    return Transducer.of("threat", 3 * REACH + 1, rule)


def transducers() -> list[Transducer]:
    return [insult_transducer(), threat_transducer(), target_transducer(), negation_transducer(), report_transducer()]


def compose(machines: list[Transducer]) -> Transducer:
    """The product of transducers over the states that can be reached: factors multiply, one at most emits or holds."""
    start = (0,) * len(machines)
    number, queue, step, factor, emit, hold = {start: 0}, [start], [], [], [], []
    for states in queue:
        rows = ([], [], [], [])
        for a in range(STOP + 1):
            to = tuple(m.step[s][a] for m, s in zip(machines, states))
            if to not in number:
                number[to] = len(queue)
                queue.append(to)
            rows[0].append(number[to])
            rows[1].append(math.prod(m.factor[s][a] for m, s in zip(machines, states)))
            for row, name in ((rows[2], "emit"), (rows[3], "hold")):
                does = [x for m, s in zip(machines, states) if (x := getattr(m, name)[s][a])]
                if len(does) > 1:
                    raise ValueError("two transducers act on one symbol")
                row.append(does[0] if does else 0)
        for table, row in zip((step, factor, emit, hold), rows):
            table.append(row)
    return Transducer(" x ".join(m.name for m in machines), step, factor, emit, hold)


@dataclass
class Grammar:
    """Weights of words and stems, and the logistic over clause evidence."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    coef: tuple[float, ...] = (-3.0, 0.8, 0.8, 0.4)

    def __post_init__(self) -> None:
        seeds = ((INSULT, SEED_INSULTS), (THREAT, SEED_THREATS), (HARMED, SEED_HARMED))
        plain = ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (AUXILIARY, AUXILIARIES))
        self.fixed = {w: (s, SEED_WEIGHT) for s, ws in seeds for w in ws.split()} | {w: (s, 0.0) for s, ws in plain for w in ws.split()}
        self.machine = compose(transducers())
        self.memo: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        got = self.memo.get(word)
        if got is None:
            if word[0] in ".!?;|\n:,":
                got = (PAUSE if word[0] in ":," else STOP, 0.0)
            else:
                got = self.fixed.get(word, (OTHER, 0.0))
                learned = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n)])
                if learned > got[1] and got[0] in (OTHER, INSULT):
                    got = (INSULT, learned)
            if len(self.memo) > 500_000:  # bounded
                self.memo.clear()
            self.memo[word] = got
        return got

    def clauses(self, text: str) -> list[tuple[int, float]]:
        """Number and score of every clause that matches."""
        out: list[tuple[int, float]] = []
        state, clause, score, held = 0, 0, 0.0, 0.0
        steps, factors, emits, holds = self.machine.step, self.machine.factor, self.machine.emit, self.machine.hold
        memo, symbol = self.memo, self.symbol
        for word in TOKEN.findall(text.lower()):
            s, weight = memo.get(word) or symbol(word)
            if s == OTHER and not state:
                continue
            emit = emits[state][s]
            if emit:
                score += (weight if emit == READ else held) * factors[state][s]
            hold = holds[state][s]
            if hold:
                held = held + weight if hold == ADD else 0.0
            state = steps[state][s]
            if s >= PAUSE:
                if score:
                    out.append((clause, score))
                clause, score = clause + 1, 0.0
        if score:
            out.append((clause, score))
        return out

    def evidence(self, text: str) -> tuple[float, float, float, int]:
        found = [s for _, s in self.clauses(text)]
        total, top, n = math.fsum(found), max(found, default=0.0), len(found)
        return math.log1p(total), top / 4.0, math.log1p(n), n

    def score(self, evidence: tuple) -> float:
        z = self.coef[0] + sum(c * x for c, x in zip(self.coef[1:], evidence[:3]))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0


def labelled_sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, scratch: Scratch) -> DataFrame:
    """``(t, y)`` of at most about ``most`` labelled training rows, chosen by a hash of their id, written once.

    Never a held-out row. The chosen labels have a proven bound, so they are broadcast and the texts
    of no other row move. An id labelled more than once is toxic if any of its labels says so; rows
    repeating an id each come in; a null id has no label.
    """
    train = labels.where(F.col(label_col).isNotNull() & F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col))
    n = train.count()
    if n > most:
        train = train.where(F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    label = (F.max(label_col) > 0).cast("int").alias("y")
    chosen = train.groupBy(F.col(f"`{id_col}`").alias(P + "id")).agg(label)
    rows = df.select(F.col(f"`{id_col}`").alias(P + "id"), F.col(f"`{text_col}`").alias("t"))
    return scratch.table(rows.join(F.broadcast(chosen), P + "id").select("t", "y"), "sample")


def induce(sample: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems far more frequent in toxic texts, with their log-odds as weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            keys = list(counts)
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([counts[k][1] for k in keys], pa.int64()), pa.array([counts[k][0] for k in keys], pa.int64())],
                names=["k", "tox", "non"],
            )
            counts.clear()
            return out

        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for k in ["#", *symbols_of(text or "")]:
                        counts.setdefault(k, [0, 0])[y] += 1
                if len(counts) > 500_000:  # bounded; what is sent in parts is added up after
                    yield flush()
        yield flush()

    both = sample.mapInArrow(run, "k string, tox long, non long").groupBy("k").agg(F.sum("tox").alias("tox"), F.sum("non").alias("non"))
    total = next(((r["tox"], r["non"]) for r in sample.agg(F.sum("y").alias("tox"), F.sum(1 - F.col("y")).alias("non")).collect()))
    if not total[0]:
        return {}, {}
    prior = total[0] / (total[0] + total[1])
    n = F.col("tox") + F.col("non")
    z = (F.col("tox") - n * prior) / F.sqrt(n * prior * (1 - prior) + 1e-9)
    weight = F.log((F.col("tox") + 0.05) / (total[0] + 0.1)) - F.log((F.col("non") + 0.5) / (total[1] + 1))
    # What is far more frequent in toxic texts, out of the words of a sample that is bounded itself.
    strong = both.where("k <> '#' AND tox >= 3 AND tox >= 4 * non").where((z >= 5.2) & (weight >= 2.5)).select("k", weight.alias("w"), "non")
    found = {r["k"]: (round(min(r["w"], 6.0), 4), r["non"]) for r in strong.collect()}
    chosen = explain(sample, found, max(1.5, LEAST_EXPLAINED * total[0]))
    return {k[1:]: found[k][0] for k in chosen if k[0] == "w"}, {k[1:]: found[k][0] for k in chosen if k[0] == "s"}


def symbols_of(text: str) -> set[str]:
    """Candidate words and stems of a text."""
    found = set()
    for w in set(TOKEN.findall(text.lower())):
        if w[0].isalpha():
            found.add("w" + w)
            found.update("s" + w[:n] for n in STEMS if len(w) >= n)
    return found


def explain(sample: DataFrame, candidates: dict[str, tuple[float, int]], least: float) -> list[str]:
    """The candidates that explain toxic texts not yet explained by better ones.

    A text counts one half for each candidate chosen in it. So words that go along with real insults,
    as all words of a text with many labelled copies do, are left out.
    """
    keys = frozenset(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, 0, 1 << 20)):
            got = [sorted(symbols_of(t or "") & keys) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if y]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.string()))], names=["found"])

    texts = sorted(r["found"] for r in sample.mapInArrow(run, "found array<string>").collect())  # MAX_LABELLED texts at most
    holders: dict[str, list[int]] = {}
    for i, own in enumerate(texts):
        for k in own:
            holders.setdefault(k, []).append(i)
    rest = np.ones(len(texts))
    at = {k: np.array(v) for k, v in holders.items()}
    bound = {k: float(len(v)) for k, v in at.items()}
    chosen: list[str] = []
    while bound:
        k = max(bound, key=lambda k: (bound[k], -candidates[k][1], len(k), k))
        now = float(rest[at[k]].sum())
        if now < least:
            if bound[k] < least:
                break
            del bound[k]
            continue
        if now < bound[k] - 1e-9:  # weights only fall, so an old sum is a bound
            bound[k] = now
            continue
        chosen.append(k)
        rest[at[k]] *= 0.5
        del bound[k]
    return chosen


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_LABELLED) -> Grammar:
    """Learn a grammar from training rows, at most about ``most`` of them.

    Without both labels among them, as with an empty table, the seeds stand alone. Null texts are empty; rows
    without an id, and null labels, are never read; rows repeating an id count each; other columns are ignored.
    """
    scratch = Scratch(df.sparkSession)
    sample = labelled_sample(df, labels, id_col, text_col, label_col, most, scratch)
    words, stems = induce(sample)
    grammar = Grammar(words, stems)
    parts = {"words": words, "stems": stems}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(**parts)
        for batch in (part for b in batches for part in slices(b, 0, 1 << 20)):
            got = [g.evidence(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in got], pa.float64()) for i in range(3)] + [batch.column(1)], names=["a", "b", "c", "y"])

    rows = sample.mapInArrow(run, "a double, b double, c double, y int").collect()  # MAX_LABELLED rows of four numbers
    x = np.array([[1.0, r["a"], r["b"], r["c"]] for r in rows]).reshape(-1, 4)
    y = np.array([r["y"] for r in rows], float)
    if 0 < y.sum() < len(y):
        x, y = x[(o := np.lexsort((*x.T, y)))], y[o]  # the same sums whatever the order of rows
        coef, ridge = np.zeros(4), np.diag([0.01, 0.5, 0.5, 0.5])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
            grad = x.T @ (p - y) + ridge @ coef
            coef -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, grad)
        grammar.coef = tuple(round(float(c), 6) for c in coef)
    scratch.drop(sample)
    return grammar


def score_toxicity(df: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, n_clauses, top_clause)`` for every row, from whole texts, without a shuffle.

    Null and empty texts match no clause and get the score of no evidence. ``top_clause`` is the
    number of the heaviest clause (of equal ones the first), null if none matched. Repeated rows and
    null ids are scored like any other, other columns are ignored, an empty table gives no rows.
    """
    parts = {"words": grammar.words, "stems": grammar.stems, "coef": grammar.coef}
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("n_clauses", T.LongType()), T.StructField("top_clause", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(**parts)
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                scores, counts, tops = [], [], []
                for text in part.column(1).to_pylist():
                    found = g.clauses(text or "")
                    total, top = math.fsum(s for _, s in found), max((s for _, s in found), default=0.0)
                    scores.append(g.score((math.log1p(total), top / 4.0, math.log1p(len(found)))))
                    counts.append(len(found))
                    tops.append(next((c for c, s in found if s == top), None))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(tops, pa.int64())], names=schema.names)

    return df.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, schema)
