"""Toxicity by a weighted finite-state pattern grammar.

A text becomes a string of word classes: insult, threat, target, negation, report, intent, quote
mark, end of clause, other. Five small transducers read it one after another and rewrite or
weigh it: negation scopes turn insults and threats into negated ones, reported speech and
quotation into reported ones, targets raise what stands in their clause, intent with a threat and
a target makes a threat clause, and the insult transducer pays out each insult's weight. They are
composed once into a single deterministic machine, whose product of states is small; a text costs
one table step for each word of a clause that holds an insult or a threat, and the others are
passed over.

The insult lexicon, with its weights, is learned from labelled rows: words and word stems whose
log-odds for toxic rows are high and that stand in several different contexts there. The context
count keeps copies of one toxic text from making its rare words insults. How high the log-odds must
be, how much a toxic text must weigh at least, and how fast the score rises around that weight, is
settled by cross-validation inside the labelled rows, with texts that are equal in one fold. The same folds tell which words before strong
insults go with clean rows (negation near, report anywhere before in the clause), and these join the
seed lists. Threats, targets and intent have seed lists alone: a threat word that labels show is in
the lexicon, and labels of whole texts do not tell whom a clause aims at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.base import map_rows, materialize, release, small_batches, table, texts
from voxloom.llm.wordbpe import Memo

#: Bounds of the labelled sample, parameters of ``labelled_sample``: rows of each label, taken in the
#: order of a hash of the id. Nothing else of the learning is cut off.
SAMPLE_TOXIC, SAMPLE_CLEAN = 8_000, 16_000
#: A lexicon entry needs so many different words before it (of 64 kinds) and log-odds of one of
#: these, the one with the largest cross-validated F1.
LEAST_CONTEXTS, ODDS = 3, (2.5, 3.0, 3.5, 4.0)
LEARN_FOLDS = 3
STEMS = (4, 5, 6)
#: A word beside strong insults joins a class with so many rows and so many standard deviations
#: between its share of toxic rows and that of all rows with strong insults.
BESIDE_ROWS, BESIDE_DEVIATIONS = 8, 4.0
#: Probability of a total weight t: logistic(BIAS + SLOPE * log(1 + t)), where nothing is learned.
BIAS, SLOPE, CUTOFF = -4.0, 3.0, 0.7

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END, INTENT = range(9)
#: What the composed machine may pay for a symbol.
NOTHING, PLAIN, AIMED, NEGATED, REPORTED, AFTER, MENACE, MENACE_WEAK = range(8)
FACTOR = {PLAIN: 1.0, AIMED: 1.3, NEGATED: 0.3, REPORTED: 0.6}
FIXED = {AFTER: 0.5, MENACE: 6.0, MENACE_WEAK: 1.5}
SCOPE = 3

WORDS = {
    THREAT: "kill hurt destroy murder beat stab shoot burn toten vernichten schlagen umbringen tuer frapper massacrer matar golpear destruir",
    TARGET: "you your yours yourself u du dich dir dein deine euch ihr tu toi te ton ta vous votre usted ustedes ti tus",
    NEGATION: "not never nor cannot nicht nie niemals kein keine pas jamais nunca jam\xe1s",
    REPORT: "said says wrote reported claimed quoted sagte schrieb berichtete dit \xe9crit dijo escribi\xf3",
    INTENT: "will gonna going shall werde werden vais allons voy vamos",
}
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n\"“”\xab\xbb]")
_MARKS = {c: END for c in ".!?;\n"} | {c: QUOTE for c in "\"“”\xab\xbb"}


# --- transducers ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: ``step(state, symbol)`` gives the next state and the symbol it
    writes. Symbols are pairs (class, mark); marks say what earlier transducers found."""

    start: tuple
    step: Callable[[tuple, tuple], tuple[tuple, tuple]]


def _negation(state, symbol):
    kind, mark = symbol
    left = state[0]
    if kind == END:
        return (0,), symbol
    if kind == NEGATION:
        return (SCOPE,), symbol
    if kind in (INSULT, THREAT) and left:
        mark = NEGATED
    return (max(0, left - 1),), (kind, mark)


def _report(state, symbol):
    told, quoted = state
    kind, mark = symbol
    if kind == END:
        return (0, quoted), symbol
    if kind == REPORT:
        return (1, quoted), symbol
    if kind == QUOTE:
        return (told, 1 - quoted if told else quoted), symbol
    if kind in (INSULT, THREAT) and (told or quoted) and mark != NEGATED:
        mark = REPORTED
    return state, (kind, mark)


def _target(state, symbol):
    seen = state[0]
    kind, mark = symbol
    if kind == END:
        return (0,), symbol
    if kind == TARGET:
        return (1,), symbol
    if kind in (INSULT, THREAT) and seen and mark == PLAIN:
        mark = AIMED
    return state, (kind, mark)


def _threat(state, symbol):
    """Intent, then a threat; a target before or after makes it a threat clause."""
    intent, armed = state
    kind, mark = symbol
    if kind == END:
        return (0, 0), symbol
    if kind == INTENT:
        return (1, armed), symbol
    if kind == THREAT:
        if mark == AIMED:
            return (intent, 0), (kind, MENACE if intent else MENACE_WEAK)
        return (intent, 0 if mark in (NEGATED, REPORTED) else 1 + intent), (kind, NOTHING)
    if kind == TARGET and armed:
        return (intent, 0), (kind, MENACE if armed == 2 else MENACE_WEAK)
    return state, (kind, mark if kind == INSULT else NOTHING)


def _insult(state, symbol):
    """Pays insults; a target behind one in its clause adds a little."""
    hit = state[0]
    kind, mark = symbol
    if kind == END:
        return (0,), symbol
    if kind == INSULT:
        return (1,), symbol
    if kind == TARGET and hit and mark == NOTHING:
        return (0,), (kind, AFTER)
    return state, symbol


PARTS = (Transducer((0,), _negation), Transducer((0, 0), _report), Transducer((0,), _target), Transducer((0, 0), _threat), Transducer((0,), _insult))


def compose(parts: tuple[Transducer, ...] = PARTS) -> list[list[tuple[int, int]]]:
    """The composition of the transducers: table[state][class] = (next state, what is paid)."""
    start = tuple(p.start for p in parts)
    number, table_, todo = {start: 0}, [], [start]
    while len(table_) < len(todo):
        states = todo[len(table_)]
        row = []
        for kind in range(9):
            symbol, after = (kind, PLAIN if kind in (INSULT, THREAT) else NOTHING), []
            for part, state in zip(parts, states, strict=True):
                state, symbol = part.step(state, symbol)
                after.append(state)
            after = tuple(after)
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row.append((number[after], symbol[1]))
        table_.append(row)
    return table_


# --- the grammar ---------------------------------------------------------------------------------


@dataclass
class Grammar:
    """Lexicon and machine; pickles small, since the memo is made anew by each worker."""

    insults: dict[str, float]
    stems: dict[str, float]
    bias: float = BIAS
    slope: float = SLOPE
    beside: dict[str, int] = field(default_factory=dict)
    machine: list = field(default_factory=compose)

    def __post_init__(self):
        self.named = {w: k for k, ws in WORDS.items() for w in ws.split()}
        self.kinds = Memo(self.kind, 200_000)

    def __getstate__(self):
        return self.insults, self.stems, self.bias, self.slope, self.beside, self.machine

    def __setstate__(self, state):
        self.insults, self.stems, self.bias, self.slope, self.beside, self.machine = state
        self.__post_init__()

    def weight(self, word: str) -> float:
        return max(self.insults.get(word, 0.0), *(self.stems.get(word[:n], 0.0) if len(word) >= n else 0.0 for n in STEMS))

    def kind(self, word: str) -> int:
        if word in _MARKS:
            return _MARKS[word]
        if word in self.named:
            return self.named[word]
        return INSULT if self.weight(word) else self.beside.get(word, OTHER)

    def hits(self, text: str | None) -> Iterator[tuple[float, float, int, int, list[str]]]:
        """What the machine pays, in order: (amount, weight of the word, its place, first place of its
        clause, all words); fixed payments have infinite weight."""
        words = _TOKEN.findall((text or "").lower())
        kinds = bytes(map(self.kinds.__getitem__, words))
        if INSULT not in kinds and THREAT not in kinds:
            return
        machine, state, start = self.machine, 0, 0
        for at, kind in enumerate(kinds):
            state, pay = machine[state][kind]
            if pay:
                if pay in FIXED:
                    yield FIXED[pay], math.inf, at, start, words
                else:
                    weight = self.weight(words[at])
                    yield FACTOR[pay] * weight, weight, at, start, words
            if kind == END:
                start = at + 1

    def clauses(self, text: str | None) -> Iterator[tuple[float, str]]:
        """(weight, words) of each clause that pays something."""
        paid, first = 0.0, None
        for amount, _, _, start, words in self.hits(text):
            if start != first and first is not None:
                yield paid, self._clause(words, first)
                paid = 0.0
            paid, first = paid + amount, start
        if first is not None:
            yield paid, self._clause(words, first)

    def _clause(self, words: list[str], start: int) -> str:
        stop = next((k for k in range(start, len(words)) if _MARKS.get(words[k]) == END), len(words) - 1)
        return " ".join(words[start : stop + 1])

    def probability(self, total: float) -> float:
        x = self.bias + self.slope * math.log1p(total)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def score(self, text: str | None) -> float:
        return self.probability(sum(amount for amount, *_ in self.hits(text)))


def _features(text: str) -> Iterator[tuple[str, str]]:
    """(feature, word before) of each word: the word itself, as =word, and its stems."""
    before = ""
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        yield "=" + w, before
        for n in STEMS:
            if len(w) >= n:
                yield w[:n], before
        before = w


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, mean loss) of the logistic regression of y on x, by Newton steps. Two rows of
    doubt, a toxic one with the least and a clean one with the largest x, keep it finite."""
    x, y = np.append(x, [x.min(), x.max()]), np.append(y, [1.0, 0.0])
    a, b = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - 1e-3 * b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a + b * x, -30, 30))), 1e-12, 1 - 1e-12)
    return float(b), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def best_cut(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(F1, cut): the cut of x with the largest F1 of y, half-way to the next smaller value; the largest
    of equal ones."""
    order = np.argsort(-x, kind="stable")
    v, hit = x[order], np.cumsum(y[order])
    last = np.flatnonzero(np.append(v[1:] < v[:-1], True))  # a cut takes all rows of one value
    f1 = 2 * hit[last] / (last + 1 + y.sum())
    k = int(np.argmax(f1))
    below = v[last[k] + 1] if last[k] + 1 < len(v) else v[last[k]]
    return float(f1[k]), float((v[last[k]] + below) / 2)


def odds_table(rows_in: DataFrame, folds: int = LEARN_FOLDS) -> DataFrame:
    """feature, odds, odds_0, odds_1, ...: log-odds for toxic rows over all rows and without each
    fold, null where the contexts do not suffice; features with at least one of the least value in
    ODDS. Input: label, fold, text.

    Toxic rows give features with their rows and a 64-bit set of contexts by fold, clean rows the
    numbers of those features; both are summed in the tasks first, then by feature.
    """
    import zlib

    def count(feed: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[str, list[int]] = {}

        def out() -> Iterator[tuple]:
            for f, v in held.items():
                yield (f, *[n - (1 << 64) * (n >> 63) for n in v])

        for label, fold, text in feed:
            seen = set()
            for f, before in _features(text):
                v = held.get(f)
                if v is None:
                    v = held[f] = [0] * (3 * folds)
                if label:
                    v[fold] |= 1 << (zlib.crc32(before.encode()) & 63)
                if f not in seen:
                    seen.add(f)
                    v[folds * (1 + (1 - label)) + fold] += 1
            if len(held) > 200_000:  # partial sums; the shuffle adds them up
                yield from out()
                held.clear()
        yield from out()

    names = [f"{c}{k}" for c in ("seen", "toxic", "clean") for k in range(folds)]
    made = map_rows(rows_in.select("label", "fold", "text"), count, "feature string, " + ", ".join(f"{n} long" for n in names))
    summed = made.groupBy("feature").agg(*[(F.bit_or(n) if n.startswith("seen") else F.sum(n)).alias(n) for n in names])
    size = {(r["label"], r["fold"]): r["count"] for r in rows_in.groupBy("label", "fold").count().collect()}

    def odds(left: list[int]):
        n1, n0 = (sum(size.get((label, k), 0) for k in left) for label in (1, 0))
        total = lambda c: sum((F.col(f"{c}{k}") for k in left), F.lit(0))
        contexts = F.bit_count(reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"seen{k}") for k in left]))
        value = F.log((total("toxic") + 0.5) / F.lit(n1 + 1.0)) - F.log((total("clean") + 0.5) / F.lit(n0 + 1.0))
        return F.when(contexts >= LEAST_CONTEXTS, F.round(value, 4))

    every = list(range(folds))
    cols = {"odds": odds(every)} | {f"odds_{f}": odds([k for k in every if k != f]) for f in every}
    out = summed.select("feature", *[c.alias(n) for n, c in cols.items()])
    return out.filter(F.greatest(F.lit(-1.0), *cols) >= min(ODDS))


def _grammar(table_: list, column: str, least: float, **more) -> Grammar:
    held = {r["feature"]: r[column] for r in table_ if r[column] is not None and r[column] >= least}
    return Grammar({f[1:]: w for f, w in held.items() if f[0] == "="}, {f: w for f, w in held.items() if f[0] != "="}, **more)


def learn(labelled: DataFrame, label_col: str = "label", text_col: str = "text") -> Grammar:
    """Grammar from labelled rows (label 1: toxic, 0: clean; other labels and null texts are
    ignored). Without a toxic or a clean row there is no lexicon.

    Log-odds come from two sums by feature (``odds_table``). Then every row is weighed by the grammar
    that does not know its fold, which gives its total at each threshold of ODDS and the words beside
    its insults; the threshold, the logistic curve and the words beside insults follow from these.
    The driver gets the lexicon and one short row for each labelled row, so it needs a bounded
    sample, as ``labelled_sample`` makes it.
    """
    fold = F.pmod(F.xxhash64("text"), F.lit(LEARN_FOLDS)).cast("int")
    rows_in = labelled.select(F.col(f"`{label_col}`").cast("int").alias("label"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text IS NOT NULL AND label IN (0, 1)").withColumn("fold", fold)
    rows_in = materialize(rows_in, "labelled")
    labels = {r["label"] for r in rows_in.select("label").distinct().collect()}
    if labels != {0, 1}:
        return Grammar({}, {})
    entries = odds_table(rows_in).collect()
    held = labelled.sparkSession.sparkContext.broadcast([_grammar(entries, f"odds_{f}", min(ODDS)) for f in range(LEARN_FOLDS)])

    def weigh(feed: Iterator[tuple]) -> Iterator[tuple]:
        beside: dict[tuple[str, int], int] = {}
        for label, fold, text in feed:
            totals, found = [0.0] * len(ODDS), set()
            for amount, weight, at, start, words in held.value[fold].hits(text):
                for k, least in enumerate(ODDS):
                    if weight >= least:
                        totals[k] += amount
                if max(ODDS) <= weight < math.inf:
                    before = [w for w in words[start:at] if not held.value[fold].weight(w)]
                    found |= {f"n{w}" for w in before if w in words[max(start, at - SCOPE) : at]} | {f"r{w}" for w in before}
                    found.add("*")
            for w in found:
                beside[w, label] = beside.get((w, label), 0) + 1
            yield None, label, 1, totals
            if len(beside) > 200_000:
                yield from ((w, k, n, None) for (w, k), n in beside.items())
                beside = {}
        yield from ((w, k, n, None) for (w, k), n in beside.items())

    weighed = materialize(map_rows(rows_in.select("label", "fold", "text"), weigh, "beside string, label int, n long, totals array<double>"), "weighed")
    rows = weighed.filter("beside IS NULL").select("label", "totals").toPandas()
    y, x = rows["label"].to_numpy(np.float64), np.log1p(np.stack(rows["totals"].to_numpy()))
    cuts, fits = [best_cut(x[:, k], y) for k in range(len(ODDS))], [fit_logistic(x[:, k], y) for k in range(len(ODDS))]
    best = max(range(len(ODDS)), key=lambda k: (cuts[k][0], -fits[k][1]))
    slope = fits[best][0]
    if slope <= 0 or cuts[best][1] <= 0:
        return _grammar(entries, "odds", ODDS[best], beside=_beside(weighed))
    # the curve keeps its slope and passes CUTOFF at the cut
    bias = math.log(CUTOFF / (1 - CUTOFF)) - slope * cuts[best][1]
    return _grammar(entries, "odds", ODDS[best], bias=bias, slope=slope, beside=_beside(weighed))


def _beside(weighed: DataFrame) -> dict[str, int]:
    """Words before strong insults that go with clean rows, with their class; a word that would be
    both is negation."""
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    pair = weighed.filter("beside IS NOT NULL").groupBy("beside").agg(of(1).alias("toxic"), of(0).alias("clean"))
    base = pair.filter("beside = '*'").first()
    if base is None:
        return {}
    n, share = F.col("toxic") + F.col("clean"), base["toxic"] / (base["toxic"] + base["clean"])
    away = (F.col("toxic") - n * share) / F.sqrt(n * share * (1 - share) + 0.5)
    found = pair.filter("beside <> '*'").filter((n >= BESIDE_ROWS) & (away <= -BESIDE_DEVIATIONS)).collect()
    kinds = {"n": NEGATION, "r": REPORT}
    return {r["beside"][1:]: kinds[r["beside"][0]] for r in sorted(found, key=lambda r: r["beside"], reverse=True) if r["beside"][1:] not in _MARKS}


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text", most_toxic: int = SAMPLE_TOXIC, most_clean: int = SAMPLE_CLEAN) -> DataFrame:
    """At most ``most_toxic`` and ``most_clean`` labelled rows with their texts: (label, text).

    Of several labels of one id the largest counts, of several texts the one that sorts first. The
    ids are chosen first, by a hash, so the sample is the same in every run; at most the sum of the
    two bounds is broadcast to the scan of the texts. Null ids and labels are left out.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    pick = lambda label, n: known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, most_toxic).unionByName(pick(0, most_clean))
    text = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")


def scores(df: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """Score of every text: doc_id, score, predicted (1 if score >= cutoff), n_clauses, worst.

    Narrow: one pass, no shuffle. Null and empty texts have no clause and the grammar's base
    score; null ids and repeated rows pass through; an empty table gives no rows; other columns
    are ignored. ``worst`` is the clause that paid most, the first of equal ones.
    """
    held = df.sparkSession.sparkContext.broadcast(grammar)

    def rows(feed: Iterator[tuple]) -> Iterator[tuple]:
        g = held.value
        for doc_id, text in feed:
            paid = list(g.clauses(text))
            s = g.probability(sum(w for w, _ in paid))
            yield doc_id, s, int(s >= cutoff), len(paid), max(paid, key=lambda p: p[0])[1] if paid else None

    return map_rows(texts(df, id_col, text_col), rows, "doc_id long, score double, predicted int, n_clauses long, worst string")


def keep_clean(df: DataFrame, grammar: Grammar, text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """Rows of ``df``, all columns, whose text scores below ``cutoff``."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf("double")
    def score(text):
        release()
        g = held.value
        return text.map(g.score).astype("float64")

    return df.filter(score(F.col(f"`{text_col}`")) < cutoff)


FOLDS, FOLD = 3, 1


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == FOLD, F.lit(False))
    grammar = learn(labelled_sample(docs, labels.filter(~held_out)))
    return scores(docs, grammar).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_clauses", "worst")
