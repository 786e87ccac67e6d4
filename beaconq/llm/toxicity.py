"""Toxicity from a weighted finite-state grammar of clauses.

Method: a lexicon transducer (an automaton of word stems) turns the words of a
clause into symbols: insult, threat, target, negation, report, other. Transducers
for negation (which reaches the next three words), reported speech and targets
rewrite an insult or threat to a marked one; they are composed into one machine,
whose last symbols are the paths. A document's score is the logistic of the weighted
paths of its matched clauses, so the same word weighs otherwise when negated or quoted.

Insult stems beyond the seed words and the weights of the paths are learned from a
bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import fold, labelled, table

#: Bounds of the training sample: so many labelled rows of a class, give or take few percent (``hash_share``).
TOXIC_ROWS, CLEAN_ROWS = 2000, 6000
THRESHOLD = 0.7
#: A learned stem explains so many, and this share, of the toxic sample beyond what
#: other stems explain, or it occurs in a larger share and explains any ...
LEAST_DOCS, LEAST_SHARE, FREQUENT_SHARE = 3, 0.005, 0.02
#: ... and is so purely toxic.
PURITY = 0.97
STEM = range(4, 10)

#: Seed words of the lexicon, the grammar's own choice. A final * leaves the ending open.
SEED = {
    "insult": "idiot* moron* stupid* scum loser* worthless pathetic imbecile* dumbass* bastard*",
    "threat": "kill* hurt murder* strangle* stab beat destroy* shoot",
    "target": "you your you're u he she they them him her this these those",
    "negation": "not never no isn't aren't wasn't nobody",
    "report": "said says called calls quoted quote reported allegedly according wrote",
}
#: Weights of the paths before learning.
PRIOR = {
    ("insult", "plain"): 5.0, ("insult", "targeted"): 5.5, ("insult", "negated"): 2.0, ("insult", "reported"): 2.5,
    ("threat", "plain"): 0.3, ("threat", "targeted"): 1.0, ("threat", "negated"): 0.1, ("threat", "reported"): 0.1,
}
PATHS = list(PRIOR)
BIAS = -4.0
NEGATION_REACH = 3

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n]")


@dataclass
class Grammar:
    """Stems by symbol, and the weights of the paths; small, and of bounded size."""

    stems: dict[str, str] = field(default_factory=lambda: {w: k for k, ws in SEED.items() for w in ws.split()})
    weights: list[float] = field(default_factory=lambda: [PRIOR[p] for p in PATHS])
    bias: float = BIAS


@dataclass
class Transducer:
    """Deterministic, a symbol out for each one in. ``arcs`` has (state, symbol) to
    (state, symbol out); where it has none, ``rest`` tells where other symbols lead
    from a state (itself, if that is missing too), and they pass as they are."""

    arcs: dict[tuple, tuple]
    rest: dict = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol: str) -> tuple:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol)


def compose(first: Transducer, second: Transducer, symbols: list[str]) -> Transducer:
    """The transducer that sends what ``first`` gives through ``second``, over all
    states that the symbols reach."""
    arcs, start = {}, (first.start, second.start)
    todo = [start]
    seen = {start}
    while todo:
        state = todo.pop()
        for symbol in symbols:
            p, middle = first.step(state[0], symbol)
            q, out = second.step(state[1], middle)
            arcs[state, symbol] = (p, q), out
            if (p, q) not in seen:
                seen.add((p, q))
                todo.append((p, q))
    return Transducer(arcs, {}, start)


SYMBOLS = [*SEED, "other"]
HITS = ("insult", "threat")


def negation() -> Transducer:
    """States count the words that a negation still reaches."""
    arcs = {(n, "negation"): (NEGATION_REACH, "negation") for n in range(NEGATION_REACH + 1)}
    arcs |= {(n, hit): (n - 1, f"{hit}/negated") for n in range(1, NEGATION_REACH + 1) for hit in HITS}
    return Transducer(arcs, {n: n - 1 for n in range(1, NEGATION_REACH + 1)})


def after(symbol: str, mark: str) -> Transducer:
    """Once ``symbol`` was met, hits that have no mark yet get this one."""
    return Transducer({(0, symbol): (1, symbol)} | {(1, hit): (1, f"{hit}/{mark}") for hit in HITS})


def grammar_machine(targeted: bool) -> tuple[list[list[int]], list[list[int]]]:
    """Tables of the composed machine: next state and path given (-1: none), by state
    and symbol. A target counts wherever in its clause it stands, so there are two
    machines, and ``targeted`` is the one for clauses that hold a target."""
    target = after("target", "targeted")
    target.start = int(targeted)
    plain = Transducer({(0, hit): (0, f"{hit}/plain") for hit in HITS})
    machine = negation()
    for other in (after("report", "reported"), target, plain):
        machine = compose(machine, other, SYMBOLS)
    states = [machine.start, *sorted({s for s, _ in machine.arcs} - {machine.start}, key=repr)]
    number = {s: k for k, s in enumerate(states)}
    paths = {"/".join(p): k for k, p in enumerate(PATHS)}
    to = [[number[machine.arcs[s, x][0]] for x in SYMBOLS] for s in states]
    out = [[paths.get(machine.arcs[s, x][1], -1) for x in SYMBOLS] for s in states]
    return to, out


class Matcher:
    """The composed machine of a grammar."""

    def __init__(self, grammar: Grammar) -> None:
        import ahocorasick

        self.grammar = grammar
        self.lexicon = ahocorasick.Automaton()
        for stem, kind in grammar.stems.items():
            self.lexicon.add_word(stem.rstrip("*"), (len(stem.rstrip("*")), stem.endswith("*"), kind))
        self.lexicon.make_automaton()
        self.machines = [grammar_machine(False), grammar_machine(True)]
        self.number = {x: k for k, x in enumerate(SYMBOLS)}

    def symbols(self, text: str) -> dict[int, str]:
        """Symbols by the start of their word in lower-case text."""
        found: dict[int, str] = {}
        for end, (size, is_open, kind) in self.lexicon.iter(text):
            start = end - size + 1
            if start and (text[start - 1].isalpha() or text[start - 1] == "'"):
                continue
            if not is_open and end + 1 < len(text) and text[end + 1].isalpha():
                continue
            found[start] = kind if found.get(start) != "insult" else "insult"
        return found

    def paths(self, text: str) -> list[int]:
        """How often each path matched."""
        low = text.lower()
        found = self.symbols(low)
        counts = [0] * len(PATHS)
        hits = sorted(s for s, kind in found.items() if kind in HITS)
        other, target = self.number["other"], self.number["target"]
        begin = 0
        for hit in hits:
            if hit < begin:
                continue
            # Clauses are read from their first word, and every part of a text once.
            for m in CLAUSE_END.finditer(low, begin, hit):
                begin = m.end()
            m = CLAUSE_END.search(low, hit)
            done = m.start() if m else len(low)
            inside = [self.number[found[w.start()]] if w.start() in found else other for w in WORD.finditer(low, begin, done)]
            to, out = self.machines[target in inside]
            state = 0
            for symbol in inside:
                if out[state][symbol] >= 0:
                    counts[out[state][symbol]] += 1
                state = to[state][symbol]
            begin = done
        return counts

    def score(self, text: str) -> float:
        return float(logistic(features(self.paths(text)) @ np.array(self.grammar.weights) + self.grammar.bias))


def features(counts) -> np.ndarray:
    """A path that matched counts 1, and a little more the oftener it did."""
    counts = np.asarray(counts, float)
    return np.minimum(counts, 1) + 0.2 * np.log2(np.maximum(counts, 1))


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def stem_candidates(text: str) -> set[str]:
    """Whole words and open stems of a text."""
    found = set()
    for w in set(WORD.findall(text.lower())):
        found.add(w)
        found.update(w[:k] + "*" for k in STEM if len(w) > k)
    return found


def choose_stems(docs: list[set[str]], counts: dict[str, int], least: int, frequent: int) -> list[str]:
    """Greedy cover: the stem in most documents not yet explained, made as specific
    as its support allows. Words that merely come along in copies of a toxic text
    explain nothing that the insult in it does not, and are not chosen."""
    left, chosen = list(docs), []
    while True:
        gain = Counter(s for d in left for s in d)
        able = [s for s, n in gain.items() if n >= least or counts[s] >= frequent]
        if not able:
            return chosen
        best = max(able, key=lambda s: (gain[s], counts[s], s))
        narrower = [s for s in gain if s.rstrip("*").startswith(best.rstrip("*")) and counts[s] >= 0.97 * counts[best]]
        chosen.append(max(narrower, key=lambda s: (len(s.rstrip("*")), not s.endswith("*"))))
        left = [d for d in left if best not in d]


def learn_weights(grammar: Grammar, rows: list[tuple[int, list[int]]], pull: float = 0.05) -> Grammar:
    """Logistic regression on path counts by Newton steps, drawn towards the prior
    weights, so that paths that do not occur in the sample keep those."""
    if not rows:
        return grammar
    x = np.array([[*features(c), 1.0] for _, c in rows])
    y = np.array([label for label, _ in rows], float)
    prior = np.array([*(PRIOR[p] for p in PATHS), BIAS])
    w = prior.copy()
    for _ in range(50):
        p = logistic(x @ w)
        slope = x.T @ (p - y) + pull * (w - prior)
        curve = (x.T * (p * (1 - p))) @ x + pull * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step / max(1.0, np.abs(step).max() / 2)
    w[:-1] = np.maximum(w[:-1], 0)
    return Grammar(grammar.stems, w[:-1].tolist(), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """Learn stems and weights. Stem counts are summed by Spark; only stems that are
    frequent and pure in the sample, and path counts of its rows, reach the driver."""
    spark = docs.sparkSession
    rows = labelled(docs, labels, "toxic", (CLEAN_ROWS, TOXIC_ROWS))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for label, text in zip(batch["label"], batch["text"]):
                (toxic if label else clean).update(stem_candidates(text))
        if stems := list(toxic | clean):
            yield pd.DataFrame({"stem": stems, "t": [toxic[s] for s in stems], "c": [clean[s] for s in stems]})

    size = rows.filter("label = 1").count()
    least = max(LEAST_DOCS, int(LEAST_SHARE * size))
    counts = rows.mapInPandas(count, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    pure = counts.filter((F.col("t") >= least) & (F.col("t") >= PURITY * (F.col("t") + F.col("c"))))
    candidates = {r["stem"]: r["t"] for r in pure.collect()}
    sent = spark.sparkContext.broadcast(frozenset(candidates))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"stems": [sorted(stem_candidates(t) & sent.value) for t in batch["text"]]})

    toxic = rows.filter("label = 1").select("text").mapInPandas(explain, "stems array<string>").collect()
    seeded = Grammar()
    stems = choose_stems([set(r["stems"]) for r in toxic], candidates, least, max(least, int(FREQUENT_SHARE * size)))
    grammar = Grammar(seeded.stems | {s: "insult" for s in stems if s.rstrip("*") not in seeded.stems})
    given = spark.sparkContext.broadcast(grammar)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = Matcher(given.value)
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "paths": [machine.paths(t) for t in batch["text"]]})

    found = rows.select("label", "text").mapInPandas(match, "label int, paths array<int>")
    kinds = found.groupBy("label", "paths").agg(F.count("*").alias("n")).collect()
    kinds.sort(key=lambda r: (r["label"], r["paths"]))
    return learn_weights(grammar, [(r["label"], r["paths"]) for r in kinds for _ in range(r["n"])])


def scorer(sent):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = Matcher(sent.value)
        for batch in batches:
            yield pd.Series([machine.score(t or "") for t in batch], dtype="float64")

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


def score_toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    A null or empty text matches nothing and scores by the bias alone. Null and
    repeated ids keep one row each; an empty table gives no rows; no other column is
    read. Time is linear in the text.
    """
    score = scorer(docs.sparkSession.sparkContext.broadcast(grammar))
    return docs.select(
        F.col("doc_id").cast("long"),
        (fold("doc_id", 3) == 1).alias("held_out"),
        score(F.col("text").cast("string")).alias("score"),
    ).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_clean(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns as they are."""
    score = scorer(docs.sparkSession.sparkContext.broadcast(grammar))
    return docs.filter(score(F.col("text").cast("string")) < THRESHOLD)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_toxicity(docs, fit(docs, labels))
