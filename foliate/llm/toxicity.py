"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers read a clause word by word: insults (words that begin like an entry of the lexicon) and threats
(phrases, as a trie of words with fallback arcs) give matches a weight; targets, negations and reported speech give them a
factor. A target near a match, before or after it, raises its weight; a negation shortly before it, or a verb of speech
anywhere before it in the clause, lowers it. The five are composed by one product (``compose``): a state is the tuple of
theirs, an arc's factor the product of theirs, and arcs are made when a text first needs them. So a clause's score comes
from its composed path and not from isolated words: negated < plain < targeted. A text's score is a logistic function
of the weights of its clauses and of their density, whose slopes can't be negative.

The lexicon of insults is learned from labels: word beginnings that mark toxic documents (any language), found by greedy
cover with a significance bound, besides seed phrases for threats. Learning uses a bounded sample of labelled rows (the
``positives`` and ``negatives`` of smallest id hash) whose crc32(id as text) mod 5 is not 0, and at most ``candidates``
beginnings of ``shortest`` to ``longest`` letters, the most frequent among toxic documents; a text's score depends on the
text alone. Only clauses that hold an insult or threat are read word by word; an Aho-Corasick automaton finds them.

Defined cases: null text is empty and scores like any text without a match; a text of any length is read whole, in linear
time, also if it is one clause; a null id is held out; repeated rows score alike; labels that are null are ignored, ids
labelled twice count as toxic if any label says so; without labelled toxic documents only the seeds are known; extra
columns are carried along, whatever their names (score and predicted are replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliate.runtime import materialise

# Words of closed classes in English, German, French and Spanish, and seed phrases.
TARGETS = "you your yours yourself u ur he she they them him her du dich dir dein ihr euch tu te toi ton vous votre tú ti usted ustedes él ella".split()
NEGATIONS = "not no never isn't aren't wasn't don't nobody neither nicht kein keine niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say called calls quoted quote reported wrote claims claimed alleged sagte nannte schrieb dit disait appelé écrit dijo llamó escribió".split()
THREATS = (
    "i will kill", "i'll kill", "kill you", "kill yourself", "going to kill", "gonna kill", "hurt you", "hope you die", "you will die",
    "beat you up", "burn your house", "ich bring dich um", "je vais te tuer", "te voy a matar",
)
CLAUSE_END = re.compile(r"[.!?;\n]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

LEAST_DOCS = 4
SECOND_SHARE = 0.4
# Weights of the grammar's arcs, and how many words a negation or a target reaches.
TARGETED, NEGATED, REPORTED, THREAT_WEIGHT = 1.5, 0.1, 0.1, 3.0
NEGATION_SCOPE, TARGET_SCOPE = 3, 4
OTHER, TARGET, NEGATION, REPORT, INSULT = range(5)


class Transducer:
    """``step(state, kind, word, match)`` -> next state, factor of a match here, factor of the latest match before."""

    start: int = 0

    def step(self, state: int, kind: int, word: int, match: bool) -> tuple[int, float, float]:
        raise NotImplementedError


class Negations(Transducer):
    """The state is how many words the latest negation still reaches."""

    def step(self, state, kind, word, match):
        return NEGATION_SCOPE if kind == NEGATION else max(0, state - 1), NEGATED if state else 1.0, 1.0


class Reports(Transducer):
    """What follows a verb of speech is reported, to the end of the clause."""

    def step(self, state, kind, word, match):
        return state or int(kind == REPORT), REPORTED if state else 1.0, 1.0


class Targets(Transducer):
    """A target before the match (states 1 to TARGET_SCOPE), or after a match that has none yet (the states above)."""

    def step(self, state, kind, word, match):
        near, open_ = state % (TARGET_SCOPE + 1), state // (TARGET_SCOPE + 1)
        later = TARGETED if kind == TARGET and open_ else 1.0
        now = TARGETED if near else 1.0
        if match:
            open_ = 0 if near else TARGET_SCOPE
        else:
            open_ = 0 if kind == TARGET else max(0, open_ - 1)
        near = TARGET_SCOPE if kind == TARGET else max(0, near - 1)
        return near + (TARGET_SCOPE + 1) * open_, now, later


class Threats:
    """A trie of the phrases' words with fallback arcs; ``step`` says whether a phrase ends here."""

    def __init__(self, phrases: tuple[str, ...]):
        self.words: dict[str, int] = {}
        self.arcs: list[dict[int, int]] = [{}]
        self.ends = [False]
        for phrase in phrases:
            at = 0
            for word in WORD.findall(phrase):
                w = self.words.setdefault(word, len(self.words))
                if w not in self.arcs[at]:
                    self.arcs[at][w] = len(self.arcs)
                    self.arcs.append({})
                    self.ends.append(False)
                at = self.arcs[at][w]
            self.ends[at] = True
        self.back = [0] * len(self.arcs)
        todo = list(self.arcs[0].values())
        for at in todo:  # breadth first: a state's fallback is known before its children's
            for w, child in self.arcs[at].items():
                todo.append(child)
                self.back[child] = self.step(self.back[at], w)[0]
                self.ends[child] |= self.ends[self.back[child]]

    def step(self, state: int, word: int) -> tuple[int, bool]:
        while word not in self.arcs[state]:
            if not state:
                return 0, False
            state = self.back[state]
        state = self.arcs[state][word]
        return state, self.ends[state]


class Grammar:
    """lexicon: word beginning -> weight."""

    def __init__(self, lexicon: dict[str, float], phrases: tuple[str, ...] = THREATS):
        self.kinds = {w: k for k, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        self.threats = Threats(phrases)
        self.parts = (Targets(), Negations(), Reports())
        self.composed: dict[tuple, tuple] = {}
        self.lexicon = lexicon
        self.sizes = sorted({len(p) for p in lexicon}, reverse=True)
        self.finder = ahocorasick.Automaton()
        for p in [*lexicon, *(max(reversed(WORD.findall(phrase)), key=len) for phrase in phrases)]:  # a phrase's longest word
            self.finder.add_word(p, len(p))
        self.finder.make_automaton()

    def insult(self, word: str) -> float:
        for n in self.sizes:
            if len(word) >= n and (w := self.lexicon.get(word[:n])) is not None:
                return w
        return 0.0

    def compose(self, state: tuple[int, ...], kind: int, word: int) -> tuple[tuple[int, ...], bool, float, float]:
        """The composed arc: next state, whether a threat ends, factor of a match here, factor of the latest one."""
        arc = self.composed.get((state, kind, word))
        if arc is None:
            threat, ends = self.threats.step(state[0], word)
            after, now, later = [threat], 1.0, 1.0
            for part, own in zip(self.parts, state[1:]):
                own, a, b = part.step(own, kind, word, ends or kind == INSULT)
                after.append(own)
                now, later = now * a, later * b
            arc = self.composed[state, kind, word] = (tuple(after), ends, now, later)
        return arc

    def clauses(self, low: str) -> Iterator[tuple[int, int]]:
        """Start and end of each clause of ``low`` that may hold an insult or threat, in linear time."""
        end = 0
        for last, size in self.finder.iter(low):
            start = last - size + 1
            if start < end or (start and low[start - 1].isalpha()):
                continue
            begin = max([low.rfind(c, end, start) for c in ".!?;\n"]) + 1 or end
            stop = CLAUSE_END.search(low, last + 1)
            end = stop.start() if stop else len(low)
            yield begin, end

    def matches(self, low: str, begin: int, end: int) -> tuple[float, float]:
        """Weights of the insults and of the threats of one clause, by its path through the composed grammar."""
        state = (0, *(t.start for t in self.parts))
        found: list[list] = []
        for m in WORD.finditer(low, begin, end):
            word = m[0]
            weight = self.insult(word)
            kind = INSULT if weight else self.kinds.get(word, OTHER)
            state, threat, now, later = self.compose(state, kind, self.threats.words.get(word, -1))
            if later != 1.0 and found:
                found[-1][0] *= later
            if threat or weight:
                found.append([now * (THREAT_WEIGHT if threat else weight), threat])
        return sum(w for w, t in found if not t), sum(w for w, t in found if t)

    def features(self, text: str) -> list[float]:
        """Weight of insults, of threats, and both per 1,000 characters, on a log scale."""
        low = text.lower()
        insults = threats = 0.0
        for begin, end in self.clauses(low):
            a, b = self.matches(low, begin, end)
            insults, threats = insults + a, threats + b
        density = 1000 * (insults + threats) / (len(low) + 200)
        return [math.log1p(2 * insults), math.log1p(2 * threats), math.log1p(density)]


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted ridge regression towards ``prior`` by Newton steps; slopes below 0 become 0 and the others are fitted again.

    The last coefficient is the intercept.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    free = np.ones(len(prior), bool)
    while True:
        b = np.where(free, prior, 0.0)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            grad = (x.T @ (w * (p - y)) + ridge * (b - prior))[free]
            hessian = ((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)))[np.ix_(free, free)]
            step = np.linalg.solve(hessian, grad)
            b[free] -= step
            if np.abs(step).max() < 1e-8:
                break
        low = free & (b < 0)
        low[-1] = False
        if not low.any():
            return b
        free &= ~low


def beginnings(text: str, shortest: int, longest: int) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return {w[:n] for w in words for n in range(shortest, min(longest, len(w)) + 1)}


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, positives: int, negatives: int) -> tuple[DataFrame, float]:
    """toxic, text of the bounded sample, and how many rows a sampled clean row stands for."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    known = materialise(known)
    n = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    sizes = {1: positives, 0: negatives}
    luck = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64(id_col), id_col).limit(size) for t, size in sizes.items()]
    picked = materialise(luck[0].unionByName(luck[1]))
    rates = {t: min(1.0, size / max(n.get(t, 0), 1)) for t, size in sizes.items()}
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(picked), id_col)
    # copies of a text would pass for as many independent documents
    rows = rows.groupBy(F.xxhash64("text").alias("copy")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    return materialise(rows.select("toxic", "text")), rates[1] / rates[0]


def learn_lexicon(rows: DataFrame, candidates: int, shortest: int, longest: int) -> dict[str, float]:
    """Word beginnings that mark toxic documents, by greedy cover; weights are bounded log odds."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in stream:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for b in beginnings(text, shortest, longest):
                    seen[b][toxic] += 1
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen)), pa.array([c[1] for c in seen.values()], pa.int64()), pa.array([c[0] for c in seen.values()], pa.int64())],
                ["begin", "pos", "neg"],
            )

    total = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n_pos, n_neg = total.get(1, 0), total.get(0, 0)
    if not n_pos:
        return {}
    sums = rows.mapInArrow(count, "begin string, pos long, neg long").groupBy("begin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rate = (F.col("pos") + 0.5) / (n_pos + 1) / ((F.col("neg") + 0.5) / (n_neg + 1))
    found = sums.filter((F.col("pos") >= LEAST_DOCS) & (rate >= 8)).orderBy(F.desc("pos"), "neg", "begin").limit(candidates).collect()
    stats = {r["begin"]: (r["pos"], r["neg"]) for r in found}
    if not stats:
        return {}

    def incidence(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            held = [sorted(beginnings(t, shortest, longest) & stats.keys()) for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if y]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], ["held"])

    docs = [set(r[0]) for r in rows.filter("toxic = 1").mapInArrow(incidence, "held array<string>").collect()]
    by: dict[str, set[int]] = defaultdict(set)
    for i, held in enumerate(docs):
        for b in held:
            by[b].add(i)
    lexicon: dict[str, float] = {}
    left = set(range(len(docs)))
    bar = math.log(1000 * len(stats))  # a candidate must be this unlikely among clean documents
    gains = {b: len(s) for b, s in by.items()}

    def evidence(b: str, hits: int) -> float:
        base = (stats[b][1] + 0.5) / (n_neg + 1)
        share = hits / max(len(left), 1)
        return hits * math.log(max(share, 1e-9) / base) if share > base else 0.0

    while left:
        best = max(gains, key=lambda b: (evidence(b, gains[b]), len(b), b), default=None)
        if best is None or gains[best] < 3 or evidence(best, gains[best]) < bar:
            break
        pos, neg = stats[best]
        lexicon[best] = min(4.0, max(0.25, math.log((pos + 0.5) / (n_pos + 1) / ((neg + 0.5) / (n_neg + 1))) / 2))
        left -= by[best]
        for b in list(gains):
            gains[b] = len(by[b] & left)
            if gains[b] < 3:
                del gains[b]
        gains.pop(best, None)
    # words that the cover could do without, as frequent and as clean as its best
    top = max((stats[b][0] for b in lexicon), default=0)
    for b, (pos, neg) in sorted(stats.items(), key=lambda x: (-x[1][0], -len(x[0]), x[0])):
        if pos >= max(LEAST_DOCS, SECOND_SHARE * top) and neg <= 0.01 * pos:
            if not any(b.startswith(known) or known.startswith(b) for known in lexicon):
                lexicon[b] = min(4.0, max(0.25, math.log((pos + 0.5) / (n_pos + 1) / ((neg + 0.5) / (n_neg + 1))) / 2))
    return lexicon


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = 3_000, negatives: int = 6_000,
    candidates: int = 20_000, shortest: int = 4, longest: int = 12,
) -> dict:
    """The model: lexicon and coefficients, as plain values."""
    rows, clean_weight = training_rows(docs, labels, id_col, text_col, positives, negatives)
    lexicon = learn_lexicon(rows, candidates, shortest, longest)

    def measure(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in stream:
            x = [grammar.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    got = rows.mapInArrow(measure, "toxic int, x array<double>").collect()  # the bounded sample
    prior = np.array([2.0, 2.5, 0.5, -4.0])
    if not got:
        return {"lexicon": lexicon, "coefficients": prior.tolist()}
    y = np.array([r[0] for r in got], float)
    weights = np.where(y == 1, 1.0, clean_weight)
    return {"lexicon": lexicon, "coefficients": fit_logistic(np.array([r[1] for r in got]), y, weights, prior).tolist()}


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted in place of equal names."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    at = docs.columns.index(text_col)
    *slopes, base = model["coefficients"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(model["lexicon"])
        for batch in stream:
            scores = []
            for value in batch.column(at):
                z = base + sum(a * b for a, b in zip(slopes, grammar.features(value.as_py() or "")))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                [*batch.schema.names, "score", "predicted"],
            )

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")
