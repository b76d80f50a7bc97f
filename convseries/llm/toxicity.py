"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insults (a lexicon induced from the labelled rows and seeds), slurs (words with an induced stem,
weaker evidence than insults), threats, targets, negations and reporting verbs. Small acceptors read the symbols of a
clause: one for what is said (insult or threat), one for whether a person is meant, one for negation that stands before
it, one for reported speech, which a quotation carries over the ends of its clauses. Their composition is a single
automaton whose final states tell how a clause matches, each with a weight. What its own clauses assert, neither negated
nor reported, also counts once by word: a text that throws many different insults weighs more than one that repeats one.
Words outside matched clauses, and those of negated or reported ones, do not enter. The weights are fitted to the
labelled rows of the training folds; a document's score is the logistic of the weights of its matched clauses.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convseries.llm.common import staged

# Fixed seeds of the grammar, in four languages.
SEED_INSULTS = frozenset("idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting dumb imbecile idiota estúpido imbécil connard abruti dummkopf arschloch abschaum".split())
THREATS = frozenset("kill killed hurt destroy beat burn stab shoot smash punch matar morir quemar tuer mourir brûler töten sterben verbrennen".split())
TARGETS = frozenset("you your yours yourself he she him her they them people women men tú vosotros ustedes ellos ella tu vous toi ils elle du ihr euch dich sie".split())
NEGATIONS = frozenset("not no never nobody isn't aren't don't doesn't wasn't won't cannot nunca nadie jamás ne pas jamais personne nicht kein keine nie niemand".split())
REPORTS = frozenset("said says say wrote writes called calls quoted quotes claimed claims reported reports according dijo dice llamó dit disait appelé selon sagte sagt nannte laut".split())

INSULT, THREAT, TARGET, NEGATION, REPORT, SLUR = range(6)
SYMBOLS = 6
#: Threats leave out words that are common ones in another of the languages, such as `die`.
#: Words, ends of clauses, and marks of quotations.
_SYMBOLS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]+|[\"“”„«»]")
_ENDS, _QUOTES = frozenset(".!?;\n"), frozenset("\"“”„«»")


@dataclass(frozen=True)
class Acceptor:
    """A deterministic acceptor over the symbols: arcs (state, symbol) -> state; others stay. States count from 0."""

    states: int
    arcs: dict[tuple[int, int], int]

    def step(self, state: int, symbol: int) -> int:
        return self.arcs.get((state, symbol), state)


#: 0 nothing, 1 insult, 2 several insults, 3 threat, 4 slur, 5 several slurs.
SAID = Acceptor(6, {(0, INSULT): 1, (1, INSULT): 2, (0, THREAT): 3, (3, INSULT): 2, (1, THREAT): 2, (0, SLUR): 4, (4, SLUR): 5, (4, INSULT): 2, (5, INSULT): 2, (1, SLUR): 2})
#: 0 nobody, 1 a person is meant.
MEANT = Acceptor(2, {(0, TARGET): 1})
#: 0 none, 1 a negation is open, 2 it met an insult or threat, 3 these came without it.
NEGATED = Acceptor(4, {(0, NEGATION): 1, (1, INSULT): 2, (1, THREAT): 2, (1, SLUR): 2, (0, INSULT): 3, (0, THREAT): 3, (0, SLUR): 3})
#: 0 none, 1 a report is open, 2 it met an insult or threat, 3 these came without it.
REPORTED = Acceptor(4, {(0, REPORT): 1, (1, INSULT): 2, (1, THREAT): 2, (1, SLUR): 2, (0, INSULT): 3, (0, THREAT): 3, (0, SLUR): 3})


def compose(*parts: Acceptor) -> tuple[dict[tuple[int, int], int], list[tuple[int, ...]]]:
    """The product automaton of the states reachable from the start: arcs, and the parts' states of each state."""
    names, todo, arcs = {(0,) * len(parts): 0}, [(0,) * len(parts)], {}
    while todo:
        state = todo.pop()
        for symbol in range(SYMBOLS):
            after = tuple(p.step(s, symbol) for p, s in zip(parts, state))
            if after not in names:
                names[after] = len(names)
                todo.append(after)
            arcs[(names[state], symbol)] = names[after]
    return arcs, sorted(names, key=names.get)


ARCS, STATES = compose(SAID, MEANT, NEGATED, REPORTED)
#: Classes of matched clauses: (what is said, a person is meant, negated, reported).
CLASSES = [(s, m, n, r) for s, m, n, r in product((1, 2, 3, 4, 5), (0, 1), (0, 1), (0, 1))]
_CLASS_OF = [CLASSES.index((s, m, int(n == 2), int(r == 2))) if s else -1 for s, m, n, r in STATES]
#: Counts of the classes; of different insults, different slurs and different slurs of one stem in asserted clauses; and the matched share.
N_FEATURES = len(CLASSES) + 4
STEM_SIZES = (4, 5, 6, 7)


def stem_counts(words: set[str]) -> Counter:
    """How many of the words have each stem (first letters) and more behind it."""
    return Counter(w[:k] for w in words for k in STEM_SIZES if len(w) > k)


class ToxicGrammar:
    """The composed grammar with its lexicon and weights."""

    def __init__(self, insults: frozenset[str], weights: np.ndarray | None = None, bias: float = 0.0, stems: frozenset[str] = frozenset()):
        self.symbols = {w: s for words, s in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT), (insults, INSULT)) for w in words}
        self.said = frozenset(w for w, s in self.symbols.items() if s in (INSULT, THREAT))
        self.stems, self.weights, self.bias = stems, weights, bias

    def stems_of(self, word: str) -> list[str]:
        """The listed stems of a word."""
        return [word[:k] for k in STEM_SIZES if len(word) > k and word[:k] in self.stems]

    def symbol(self, word: str) -> int | None:
        """A word's symbol, if it has one."""
        found = self.symbols.get(word)
        return SLUR if found is None and self.stems_of(word) else found

    def known(self, words: set[str]) -> dict[str, int]:
        """The symbols of those words that have one."""
        return {w: s for w in words if (s := self.symbol(w)) is not None}

    @staticmethod
    def matches(words: list[str], known: dict[str, int]):  # noqa: ANN205
        """The matched clauses of a text's words and marks as (first word, end, class number, words that say it).

        A quotation that opens after a reporting verb reports up to its end mark, at most to the end of its line."""
        state, first, said, reported = 0, 0, [], False
        for k, w in enumerate([*words, "\n"]):
            if w[0] in _ENDS:
                if _CLASS_OF[state] >= 0:
                    yield first, k, _CLASS_OF[state], said
                reported = reported and "\n" not in w
                state, first, said = ARCS[(0, REPORT)] if reported else 0, k + 1, []
            elif w in _QUOTES:
                if reported and state == ARCS[(0, REPORT)]:  # the quotation ended with the clause before
                    state = 0
                reported = not reported and STATES[state][3] == 1
            elif (s := known.get(w)) is not None:
                state = ARCS[(state, s)]
                if s in (INSULT, SLUR):
                    said.append(w)

    def clauses(self, text: str | None) -> list[tuple[str, tuple[int, int, int, int]]]:
        """Matched clauses of a text as (clause, class); none for null."""
        words = list(_SYMBOLS.finditer(text or ""))
        lower = [m[0].lower() for m in words]
        found = self.matches(lower, self.known(set(lower)))
        return [(text[words[a].start() : words[b - 1].end()], CLASSES[c]) for a, b, c, _ in found]

    def features(self, text: str | None) -> np.ndarray:
        """Logarithms of the counts that N_FEATURES names."""
        x = np.zeros(N_FEATURES)
        words = _SYMBOLS.findall(text.lower()) if text else []
        known = self.known(set(words))
        if not {INSULT, THREAT, SLUR} & set(known.values()):
            return x
        asserted: set[str] = set()
        for _, _, c, said in self.matches(words, known):
            x[c] += 1
            if CLASSES[c][2:] == (0, 0):
                asserted.update(said)
        slurs = {w: self.stems_of(w) for w in asserted if known[w] == SLUR}
        x[-1] = 100 * x[:-4].sum() / (len(words) + 20)
        x[-2] = max(Counter(t for found in slurs.values() for t in found).values(), default=0)
        x[-3] = len(slurs)
        x[-4] = len(asserted) - len(slurs)
        return np.log1p(x)

    def score(self, text: str | None) -> float:
        """Between 0 and 1."""
        z = self.bias + float(self.features(text) @ self.weights)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    beta, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def is_held_out(id_col: str) -> F.Column:
    """Whether crc32 of the id as text is divisible by 5; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train_grammar(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000) -> ToxicGrammar:
    """Learns the insults and the weights from labelled rows of the training folds: about sample_rows of them at most, chosen by hashes of the id and of the row.

    An insult is a word of at least 3 toxic documents for which the lower Wilson bound of its documents' share of toxic
    labels is over one half. A slur's stem is one for which this holds of the documents with two or more such words, at
    least 8 of them toxic. Null labels are left out; of repeated ids the largest label counts; rows that repeat an id and
    its text count once. With fewer than 20 labelled rows, or one label only, the seeds and fixed weights remain.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    part = lambda n: F.lit(min(2**63 - 1, 2**63 * sample_rows // max(1, n)))  # noqa: E731  of the range of a 63-bit hash
    known = known.where(F.xxhash64("_id").bitwiseAND(2**63 - 1) < part(known.count()))  # about sample_rows rows: small enough to broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), "_id")
    rows = staged(rows.dropDuplicates(["_id", "text"]), "labelled")
    rows = rows.where(F.xxhash64("text", "_id").bitwiseAND(2**63 - 1) < part(rows.count()))  # an id may stand on many rows

    def surest(counted: DataFrame, least: int) -> frozenset[str]:
        """The terms of (term, k toxic, n documents) whose lower Wilson bound is over one half."""
        share, z2 = F.col("k") / F.col("n"), 1.96**2
        low = (share + z2 / (2 * F.col("n")) - 1.96 * F.sqrt((share * (1 - share) + z2 / (4 * F.col("n"))) / F.col("n"))) / (1 + z2 / F.col("n"))
        found = counted.where(F.col("k") >= least).withColumn("low", low).where("low > 0.5")
        return frozenset(r["term"] for r in found.collect())

    def count_stems(batches):
        import pandas as pd

        for part in batches:
            k, n = Counter(), Counter()
            for y, text in zip(part["y"], part["text"]):
                found = [t for t, times in stem_counts({w for w in _SYMBOLS.findall(text.lower()) if w[0].isalpha()}).items() if times > 1]
                n.update(found)
                if y:
                    k.update(found)
            if n:
                yield pd.DataFrame({"term": list(n), "k": [k[t] for t in n], "n": list(n.values())})

    words = rows.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("term"))
    insults = surest(words.groupBy("term").agg(F.sum("y").alias("k"), F.count("*").alias("n")), 3)
    stems = surest(rows.select("y", "text").mapInPandas(count_stems, "term string, k long, n long").groupBy("term").agg(F.sum("k").alias("k"), F.sum("n").alias("n")), 8)
    grammar = ToxicGrammar(SEED_INSULTS | insults, stems=stems)

    def extract(batches):
        import pandas as pd

        for part in batches:
            yield pd.DataFrame({"y": part["y"], "x": [grammar.features(t).tolist() for t in part["text"]]})

    sample = rows.select("y", "text").mapInPandas(extract, "y int, x array<double>").toPandas()
    if len(sample) < 20 or sample["y"].nunique() < 2:
        grammar.weights, grammar.bias = np.where([c[2] or c[3] for c in CLASSES] + [False] * 4, 0.5, 1.5), -2.0
        return grammar
    grammar.weights, grammar.bias = fit_logistic(np.vstack(sample["x"].to_numpy()), sample["y"].to_numpy(float))
    return grammar


def score_toxicity(docs: DataFrame, grammar: ToxicGrammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted. Null and empty texts get the score of no match; repeated rows stay; texts of any length are read whole; other columns do not matter; an empty table gives an empty result."""

    def score(batches):
        for rows in batches:
            rows["score"] = [grammar.score(t) for t in rows["text"]]
            yield rows[["id", "score"]]

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = base.mapInPandas(score, f"id {dict(base.dtypes)['id']}, score double").withColumnRenamed("id", id_col)
    return out.select(id_col, is_held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
