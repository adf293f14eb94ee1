"""Operator 4: toxicity by a lexicon trie intersected with Levenshtein automata.

The lexicon is learnt: words and word beginnings that a bounded sample of labelled
documents ties to the label, chosen greedily for documents that few chosen ones occur in.
Its trie is intersected with the Levenshtein automata of its entries, each with an
edit budget of its own: entries of five letters or more may be one edit away, shorter
ones may not.  The product is made deterministic as words ask for it, so that only
states that some word reaches are built; all words of a batch run through it in lock step.

Each hit is looked at in its context window: between quotation marks, or near a
word of reporting, it counts as a quotation, else as abuse.  A logistic model of
each entry's exact and misspelt hits, and of the quoted ones, gives the score.

Only rows that are not held out are learnt from, at most ``max_rows`` of them, one
for each labelled id (of several rows, the one of the least text hash).  Every
document is scored in one pass without a shuffle, whole texts however long.  A null
text is an empty one, and an empty text has the score of no hits.  Equal texts score
alike; repeated rows stay.  Without labels the score is 0.5, and a table without rows
gives none.  Other columns are neither read nor changed.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvec.llm._util import STEP_BYTES, held_out, sampled
from sparkvec.llm._words import steps

#: Most labelled rows that a model is fitted on.
MAX_ROWS = 20_000
#: Candidates for the lexicon, and its entries at most (of a model, not of the data).
CANDIDATES, ENTRIES = 2_000, 250
#: Lengths of word beginnings that may be entries; fewest letters of an entry that may be misspelt.
STEMS, FUZZY_FROM = (3, 4, 5, 6, 7, 8), 5
#: Code points to either side in which quotation marks count, and words in which cues do.
MARKS_WITHIN, CUES_WITHIN = 60, 5
THRESHOLD = 0.7
#: Words of reporting in four languages, and quotation marks.
CUES = ("said", "says", "called", "quote", "quoted", "wrote", "word", "sagte", "nannte", "zitat", "schrieb", "dit", "appelé", "citation", "dijo", "llamó", "cita", "palabra")
MARKS = "\"“”„«»‹›"
_TOKEN = re.compile(r"(?:[^\W_]|@)+")
#: Entries below which greedy choice stops, and what a chosen entry leaves of the weight of its documents.
LEAST_GAIN, DECAY = 6, 0.6
#: States that an automaton keeps between batches; one that has more starts anew.
STATES = 50_000


class Automaton:
    """The product of a trie and the Levenshtein automata of its entries, deterministic and built on demand.

    An entry that ends in ``*`` accepts any continuation.  Entries that may be
    misspelt and those that may not stand in tries of their own, so a node's budget
    is that of every entry that ends there.  A state is the best open entry met so
    far, exact and misspelt, and the set of live (trie node, edits made).  State 0 is
    dead, 1 the start.

    output: 0 none, 1 exact, 2 misspelt, 3 cue; entry: which one, the longest if there are several.
    """

    def __init__(self, entries: list[str], cues: tuple[str, ...] = CUES, fuzzy_from: int = FUZZY_FROM):
        self.given = entries, cues, fuzzy_from
        self.entries = len(entries)
        self.size = [len(e.rstrip("*")) for e in entries]
        self.children: list[dict[int, int]] = [{}, {}]  # roots: 0 no edit, 1 one edit
        self.fuzzy = [False, True]
        self.exact, self.open, self.cue = [-1, -1], [-1, -1], [False, False]
        letters = sorted({c for e in entries for c in e.rstrip("*")} | {c for w in cues for c in w})
        place = {c: i for i, c in enumerate(letters, 1)}
        self.letters = np.zeros(65536, np.int16)  # class of each code point; 0: no letter of the lexicon
        astral = [c for c in letters if ord(c) > 65535]
        self.letters[[ord(c) for c in letters if ord(c) < 65536]] = [place[c] for c in letters if ord(c) < 65536]
        self.astral, self.astral_class = np.array([ord(c) for c in astral], np.uint32), np.array([place[c] for c in astral], np.int16)
        self.classes = len(letters) + 1
        for i, e in enumerate(entries):
            word = e.rstrip("*")
            node, where = self._path(word, int(len(word) >= fuzzy_from), place), self.open if e.endswith("*") else self.exact
            where[node] = i if where[node] < 0 else where[node]
        for w in cues:
            self.cue[self._path(w, 0, place)] = True
        self.reset()

    def __reduce__(self):
        return Automaton, self.given

    def _path(self, word: str, root: int, place: dict[str, int]) -> int:
        at = root
        for c in word:
            if place[c] not in self.children[at]:
                self.children[at][place[c]] = len(self.children)
                self.children.append({})
                self.fuzzy.append(bool(root))
                self.exact.append(-1)
                self.open.append(-1)
                self.cue.append(False)
            at = self.children[at][place[c]]
        return at

    def reset(self) -> None:
        dead = (-1, -1, frozenset())
        self.number, self.order = {dead: 0}, [dead]
        self.step = np.full((1024, self.classes), -1, np.int32)
        self.step[0] = 0
        self.output, self.entry = np.zeros(1024, np.int8), np.zeros(1024, np.int32)
        self._state(self._settled(-1, -1, {(0, 0), (1, 0)}))

    def _state(self, state: tuple) -> int:
        if state not in self.number:
            n = self.number[state] = len(self.order)
            self.order.append(state)
            if n == len(self.step):
                self.step = np.concatenate([self.step, np.full_like(self.step, -1)])
                self.output, self.entry = (np.concatenate([x, np.zeros_like(x)]) for x in (self.output, self.entry))
            self.output[n], self.entry[n] = self._said(state)
        return self.number[state]

    def _longer(self, a: int, b: int) -> int:
        return b if a < 0 or (b >= 0 and self.size[b] > self.size[a]) else a

    def _settled(self, exact: int, near: int, live: set) -> tuple:
        """A state from what is live before the letters that a word lacks are passed over."""
        for node, made in list(live):
            if not made and self.fuzzy[node]:
                live.update((child, 1) for child in self.children[node].values())
        for node, made in live:
            if self.open[node] >= 0:
                if made:
                    near = self._longer(near, self.open[node])
                else:
                    exact = self._longer(exact, self.open[node])
        # What an exact match has settled, or the same node without an edit, needs no edits any more.
        if exact >= 0:
            return exact, -1, frozenset(x for x in live if not x[1])
        return exact, near, frozenset(x for x in live if not x[1] or (x[0], 0) not in live)

    def _after(self, state: tuple, letter: int) -> tuple:
        out = set()
        for node, made in state[2]:
            if (child := self.children[node].get(letter)) is not None:
                out.add((child, made))
            if not made and self.fuzzy[node]:
                out.add((node, 1))  # a letter too many
                out.update((child, 1) for child in self.children[node].values())  # another letter
        return self._settled(state[0], state[1], out)

    def _said(self, state: tuple) -> tuple[int, int]:
        """(kind, entry) of a word that ends in a state; of equal length a closed entry goes before an open one."""
        best = [-1, -1]
        for made in (0, 1):
            for node, m in state[2]:
                if m == made:
                    best[made] = self._longer(best[made], self.exact[node])
            if state[made] >= 0 and (best[made] < 0 or self.size[state[made]] > self.size[best[made]]):
                best[made] = state[made]
        if best[0] >= 0:
            return 1, best[0]
        if best[1] >= 0:
            return 2, best[1]
        return (3, 0) if any(self.cue[node] for node, _ in state[2]) else (0, 0)

    def after(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states that follow; those not yet known are built."""
        then = self.step[state, letter]
        if (new := then < 0).any():
            for s, c in np.unique(np.stack([state[new], letter[new]], axis=1), axis=0).tolist():
                n = self._state(self._after(self.order[s], c))
                self.step[s, c] = n
            then = self.step[state, letter]
        return then

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point."""
        out = self.letters[np.minimum(points, 65535)]
        if len(big := np.flatnonzero(points > 65535)):
            out[big] = 0
            if len(self.astral):
                at = np.minimum(np.searchsorted(self.astral, points[big]), len(self.astral) - 1)
                out[big] = np.where(self.astral[at] == points[big], self.astral_class[at], 0)
        return out


def compile_automaton(entries: list[str], cues: tuple[str, ...] = CUES, fuzzy_from: int = FUZZY_FROM) -> Automaton:
    return Automaton(entries, cues, fuzzy_from)


def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(65536)]) | (np.arange(65536) == ord("@"))


@dataclass
class Hits:
    """Per text: words, and hits that are exact abuse, exact quoted, misspelt abuse, misspelt quoted.

    Of the abuse, each (text, 2 * entry + misspelt) that occurs, in order, and how often.
    """

    counts: np.ndarray
    text: np.ndarray
    which: np.ndarray
    times: np.ndarray


def hits(texts: list[str], machine: Automaton, inside: np.ndarray) -> Hits:
    if len(machine.order) > STATES:
        machine.reset()
    n, none = len(texts), np.zeros(0, np.int64)
    lowered = [t.lower() for t in texts]
    size = np.array([len(t) for t in lowered], np.int64)
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((n, 5))
    if not len(points):
        return Hits(out, none, none, none)
    letter = inside[np.minimum(points, 65535)]
    if len(big := np.flatnonzero(points > 65535)):
        known, back = np.unique(points[big], return_inverse=True)
        letter[big] = np.array([chr(c).isalnum() for c in known.tolist()])[back]
    bounds = np.concatenate([[0], np.cumsum(size)])
    before = np.empty_like(letter)
    before[1:], before[0] = letter[:-1], False
    before[bounds[bounds < len(points)]] = False
    starts = np.flatnonzero(letter & ~before)
    after = np.empty_like(letter)
    after[:-1], after[-1] = letter[1:], False
    after[bounds[bounds > 0] - 1] = False
    ends = np.flatnonzero(letter & ~after) + 1
    first = np.searchsorted(starts, bounds)
    out[:, 0] = np.diff(first)
    kinds = machine.kinds(points)
    found, which = np.zeros(len(starts), np.int8), np.zeros(len(starts), np.int32)
    live, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), 0
    while len(live):
        state = machine.after(state, kinds[starts[live] + at])
        at += 1
        over = ends[live] - starts[live] == at
        found[live[over]] = machine.output[state[over]]
        which[live[over]] = machine.entry[state[over]]
        keep = ~over & (state != 0)
        live, state = live[keep], state[keep]
    hit = np.flatnonzero((found == 1) | (found == 2))
    if not len(hit):
        return Hits(out, none, none, none)
    text = np.searchsorted(first, hit, side="right") - 1
    marks = np.concatenate([[0], np.cumsum(np.isin(points, [ord(c) for c in MARKS]))])
    lo, hi = bounds[text], bounds[text + 1]
    opened = marks[starts[hit]] > marks[np.maximum(lo, starts[hit] - MARKS_WITHIN)]
    closed = marks[np.minimum(hi, ends[hit] + MARKS_WITHIN)] > marks[ends[hit]]
    cue = np.flatnonzero(found == 3)
    near = np.searchsorted(cue, np.minimum(hit + CUES_WITHIN + 1, first[text + 1])) > np.searchsorted(cue, np.maximum(hit - CUES_WITHIN, first[text]))
    quoted = (opened & closed) | near
    np.add.at(out, (text, 1 + 2 * (found[hit] == 2) + quoted), 1)
    own = hit[~quoted]
    each, times = np.unique(np.stack([text[~quoted], 2 * which[own] + (found[own] == 2)]), axis=1, return_counts=True)
    return Hits(out, each[0], each[1], times)


def features(counts: np.ndarray) -> np.ndarray:
    """The features that are no single entry's."""
    n, hit = np.maximum(counts[:, :1], 1), counts[:, 1:5]
    return np.column_stack([np.ones(len(counts)), np.log1p(n) / 5, np.log1p(hit), hit > 0, np.minimum(20 * hit / n, 3)])


COMMON = 14


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps over blocks of rows; the first column is the intercept."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        grad, hess = penalty * w, np.diag(penalty)
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048].astype(float)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            grad = grad + part.T @ (p - y[at : at + 2048])
            hess = hess + (part * (p * (1 - p) + 1e-9)[:, None]).T @ part
        step = np.linalg.solve(hess, grad)
        step *= min(1, 3 / max(1e-9, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class ToxicityModel:
    entries: list[str]
    machine: Automaton
    weights: np.ndarray

    def score(self, found: Hits) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(found.counts), 0.5)
        own = np.bincount(found.text, weights=self.weights[COMMON + found.which] * np.log1p(found.times), minlength=len(found.counts))
        # Rounded, so that equal texts score alike wherever in a batch they stand.
        return np.round(1 / (1 + np.exp(-np.clip(features(found.counts) @ self.weights[:COMMON] + own, -30, 30))), 9)


def _tokens(text: str) -> set[str]:
    """Words of a text, and the beginnings of those that are longer."""
    found = set(_TOKEN.findall(text.lower()))
    return found | {f"{w[:n]}*" for w in found for n in STEMS if len(w) > n}


def _sample(docs: DataFrame, labels: DataFrame, column: str, max_rows: int) -> DataFrame:
    """(y, text) of at most ``max_rows`` labelled documents, one row an id."""
    return sampled(docs, labels, column, max_rows).select("y", F.coalesce("text", F.lit("")).alias("text"))


def learn_lexicon(sample: DataFrame) -> list[str]:
    """Entries that the labels of sample (y, text) single out; open beginnings end in ``*``."""

    def count(batches):
        total: Counter = Counter()
        toxic: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([toxic[t] for t in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["token", "pos", "all"])

        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = _tokens(text)
                total.update(found)
                if y:
                    toxic.update(found)
                if len(total) > 500_000:
                    yield flush()
                    total.clear()
                    toxic.clear()
        if total:
            yield flush()

    rate = sample.agg(F.avg("y"), F.sum("y")).first()
    if not rate[1] or rate[0] == 1:
        return []
    base, least = rate[0], 4
    counted = sample.select("y", "text").mapInArrow(count, "token string, pos long, all long").groupBy("token").agg(F.sum("pos").alias("pos"), F.sum("all").alias("all"))
    share = F.col("pos") / F.col("all")
    # How unlikely so many labelled documents would be by chance, in bits.
    odd = F.col("all") * (share * F.log2(share / base) + F.when(share < 1, (1 - share) * F.log2((1 - share) / (1 - base))).otherwise(0.0))
    best = counted.where((F.col("pos") >= least) & (share >= min(2.5 * base, (1 + base) / 2))).withColumn("odd", odd).orderBy(F.desc("odd"), F.length("token"), "token").limit(CANDIDATES)
    rows = best.where(F.col("odd") > 12).collect()
    tokens, odds = [r.token for r in rows], np.array([r.odd for r in rows])
    number = {t: i for i, t in enumerate(tokens)}
    if not tokens:
        return []

    def mark(batches):
        for batch in batches:
            rows = [sorted(number[t] for t in _tokens(text) if t in number) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], names=["tokens"])

    flat, row = [np.zeros(0, np.int64)], 0
    of = [np.zeros(0, np.int64)]
    for r in sample.where("y = 1").select("text").mapInArrow(mark, "tokens array<int>").toLocalIterator():  # at most max_rows
        flat.append(np.array(r.tokens, np.int64))
        of.append(np.full(len(r.tokens), row))
        row += 1
    flat, of = np.concatenate(flat), np.concatenate(of)
    size = np.maximum(np.bincount(flat, minlength=len(tokens)), 1)
    chosen, weight = [], np.ones(row)
    while len(chosen) < min(ENTRIES, len(tokens)):
        gain = odds * np.bincount(flat, weights=weight[of], minlength=len(tokens)) / size
        gain[chosen] = 0
        i = int(gain.argmax())
        if gain[i] < LEAST_GAIN:
            break
        chosen.append(i)
        weight[of[flat == i]] *= DECAY
    return [tokens[i] for i in chosen]


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", max_rows: int = MAX_ROWS) -> ToxicityModel:
    sample = _sample(docs, labels, column, max_rows).persist()
    try:
        entries = learn_lexicon(sample)
        machine = compile_automaton(entries)

        def run(batches):
            inside = _letter_table()
            for batch in batches:
                for part in steps(batch, "text", STEP_BYTES):
                    found = hits(part.column("text").to_pylist(), machine, inside)
                    edge = np.searchsorted(found.text, np.arange(part.num_rows + 1)).tolist()
                    lists = [pa.array([x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()) for x in (found.which.astype(np.int32), found.times.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([part.column("y"), pa.array([c.tobytes() for c in found.counts.astype(np.float32)], pa.binary()), *lists], names=["y", "counts", "which", "times"])

        x, y = np.zeros((max_rows, COMMON + 2 * len(entries)), np.float32), []
        for row in sample.mapInArrow(run, "y int, counts binary, which binary, times binary").toLocalIterator():  # at most max_rows, of bounded width
            x[len(y), :COMMON] = features(np.frombuffer(row.counts, np.float32)[None, :].astype(float))[0]
            x[len(y), COMMON + np.frombuffer(row.which, np.int32)] = np.log1p(np.frombuffer(row.times, np.int32))
            y.append(row.y > 0)
        if not y:
            return ToxicityModel(entries, machine, np.zeros(0))
        return ToxicityModel(entries, machine, logistic(x[: len(y)], np.array(y, float)))
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and ``score`` (0 to 1) of every row of docs (..., text)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(*keep, F.col("text").cast("string").alias("__text"))

    def run(batches):
        inside = _letter_table()
        for batch in batches:
            for part in steps(batch, "__text", STEP_BYTES):
                found = hits([t or "" for t in part.column("__text").to_pylist()], shipped.value.machine, inside)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(shipped.value.score(found))], names=[*keep, "__score"])

    kept = slim.select(*keep).schema
    return slim.mapInArrow(run, T.StructType([*kept.fields, T.StructField("__score", T.DoubleType())])).withColumnRenamed("__score", "score")


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, fit(docs, labels, "toxic", max_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
