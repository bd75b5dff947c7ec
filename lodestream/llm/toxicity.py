"""Toxicity from a lexicon that also matches misspelt terms.

The lexicon is learned from labelled documents: words more of whose rows are
toxic than chance explains, and found in many different surroundings (so that
copies of one document do not make a term of each of its words). Its trie is
intersected with Levenshtein automata: a word is read once, letter by letter,
through the lazily determinised product, and is a hit if it ends within the
distance its term allows: by its length, and none for a term whose neighbours in
the sample are mostly words of clean texts. The words around a hit tell abuse
(second person, no quotation marks) from quotation (quotation marks, verbs of
speech). A logistic model over these hits, fitted on the labelled rows of the
training folds, gives the score; a misspelt hit counts as an exact one, but for
what the labels say against it.

A null text is the empty text; it gets the score of a text without hits. Texts of
any length are read whole. Labels that are null do not count; repeated rows are
scored alike; of terms as near, the first counts. Without labels, or with one kind
of them, the score is the share of toxic rows. Empty tables give empty results.
Other columns pass through; a column with the name of the output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestream.llm.common import id_and_text, slices

#: At most so many labelled rows are used to learn the lexicon and to fit the model.
LABELLED_ROWS = 12_000
#: Terms of the lexicon, at most.
TERMS = 400
#: At least this share of a term's rows is toxic, and by chance so many were with a probability of e^-12 at most (Chernoff's bound).
LEAST_PRECISION, LEAST_EVIDENCE = 0.75, 12.0
#: Different words before a term, as a share of its rows.
LEAST_CONTEXTS = 0.4
WINDOW = 8
DENSE_WINDOW = 50
#: Words of speech and marks that quote; words that address.
QUOTING = {"said", "says", "say", "quote", "quoted", "quotes", "called", "wrote", "word", "words", "term", "phrase", "insult", "insults", "slur", "dit", "sagte", "dijo"}
ADDRESSING = {"you", "your", "youre", "yourself", "u", "ur", "du", "tu", "vous", "ihr", "sie", "usted", "they", "he", "she"}
MARKS = "\"“”«»„‘’"
#: Chunks that a task remembers, and their letters; longer ones are read each time.
_KEPT_WORDS, _KEPT_LETTERS = 200_000, 40
#: Steps of the automaton that a task remembers.
_KEPT_STEPS = 1_000_000


def allowed(length: int) -> int:
    """Edits that a misspelling of a term of ``length`` letters may have."""
    return 0 if length < 5 else 1 if length < 9 else 2


class LexiconAutomaton:
    """The product of a trie of terms and Levenshtein automata, determinised as words are read.

    A state is a set of (trie node, edits so far), the least edits for each node.
    """

    def __init__(self, terms: list[str], limits: list[int] | None = None):
        self.children: list[dict[str, int]] = [{}]
        self.term_at: dict[int, int] = {}
        for k, term in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.term_at[node] = k
        self.limit = [allowed(len(t)) for t in terms] if limits is None else limits
        self.most = [-1] * len(self.children)  # edits that any term below a node allows; children come after their parents
        for node, k in self.term_at.items():
            self.most[node] = self.limit[k]
        for node in reversed(range(len(self.children))):
            self.most[node] = max([self.most[node], *(self.most[child] for child in self.children[node].values())])
        self.forget()

    def forget(self) -> None:
        """Begins with no states but the first."""
        self.states: list[dict[int, int]] = []
        self.index: dict[frozenset, int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        queue = list(nodes)
        while queue:  # letters of a term left out
            node = queue.pop()
            e = nodes[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and nodes.get(child, e + 1) > e:
                    nodes[child] = e
                    queue.append(child)
        key = frozenset(nodes.items())
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(nodes)
        return self.index[key]

    def _step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}
        for node, e in self.states[state].items():
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and nodes.get(child, cost + 1) > cost:
                    nodes[child] = cost
            if e + 1 <= self.most[node] and nodes.get(node, e + 2) > e + 1:
                nodes[node] = e + 1
        to = self._state(nodes) if nodes else -1
        self.steps[state, c] = to
        return to

    def matches(self, word: str) -> list[tuple[int, int]]:
        """(edits, term) of every term within its limit."""
        state, steps = self.start, self.steps
        for c in word:
            to = steps.get((state, c))
            state = self._step(state, c) if to is None else to
            if state < 0:
                return []
        return [(e, self.term_at[n]) for n, e in self.states[state].items() if n in self.term_at and e <= self.limit[self.term_at[n]]]

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term within its limit; ties go to the first term."""
        found = self.matches(word)
        return min(found)[::-1] if found else None


#: What the model sees of a text, in this order.
FEATURES = ("hits", "quoted", "misspelt", "misspelt_quoted", "addressed", "density", "densest")


@dataclass
class Scanner:
    """Finds hits in texts; remembers what it has found for each chunk between spaces."""

    terms: list[str]
    limits: list[int] | None = None
    automaton: LexiconAutomaton = field(init=False)
    known: dict = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.automaton = LexiconAutomaton(self.terms, self.limits)

    def _chunk(self, chunk: str) -> tuple[int, int] | bool:
        found = min((m for w in re.findall(r"[^\W_]+", chunk) if (m := self.automaton.match(w))), key=lambda m: m[1], default=False)
        if len(chunk) <= _KEPT_LETTERS:
            if len(self.known) > _KEPT_WORDS:
                self.known.clear()
            self.known[chunk] = found
        if len(self.automaton.steps) > _KEPT_STEPS:
            self.automaton.forget()
        return found

    def features(self, text: str) -> list[float]:
        chunks = text.lower().split()
        found = [*map(self.known.get, chunks)]
        if None in found:
            known = self.known
            for k, x in enumerate(found):
                if x is None:
                    x = known.get(chunks[k])
                    found[k] = self._chunk(chunks[k]) if x is None else x
        hits = [k for k, x in enumerate(found) if x]
        out = [0.0] * len(FEATURES)
        if not hits:
            return out
        for k in hits:
            around = chunks[max(0, k - WINDOW) : k + WINDOW + 1]
            words = {re.sub(r"\W+", "", w) for w in around}
            quoted = bool(words & QUOTING) or (chunks[k][0] in MARKS or chunks[k][-1] in MARKS) or (any(m in w for w in chunks[max(0, k - WINDOW) : k] for m in MARKS) and any(m in w for w in chunks[k + 1 : k + WINDOW + 1] for m in MARKS))
            out[quoted] += 1
            out[2 + quoted] += found[k][1] > 0
            out[4] += bool(words & ADDRESSING)
        out = [float(np.log1p(x)) for x in out]
        out[5] = 20 * len(hits) / (len(chunks) + 20)
        at = np.array(hits)
        out[6] = float(np.log1p(max(np.searchsorted(at, at + DENSE_WINDOW) - np.arange(len(at)))))
        return out


@dataclass(frozen=True)
class ToxicityModel:
    """Learned terms and logistic weights; its size does not depend on the corpus."""

    terms: tuple[str, ...]
    limits: tuple[int, ...]
    weights: tuple[float, ...]
    bias: float


def in_training_folds(id_col: str = "doc_id"):
    """The fold rule of the labels: rows whose crc32 of the id as text is a multiple of 5 are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """text and label of at most ``rows`` labelled rows of the training folds, chosen by a hash of the id.

    The chosen ids are a bounded table, so they are broadcast to the scan of the texts.
    Of rows that repeat an id the least text counts.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).where(in_training_folds())
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([l2] * x.shape[1] + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def tolerances(sample: DataFrame, lexicon: list[str]) -> list[int]:
    """Edits that each term allows: none where words that near it are mostly in clean texts of the sample (label, text)."""
    first = [allowed(len(t)) for t in lexicon]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, near = LexiconAutomaton(lexicon, first), {}
        seen = np.zeros((2, len(lexicon)), np.int64)
        for batch in slices(batches):
            for label, text in zip(batch["label"].to_pylist(), batch["text"].to_pylist(), strict=True):
                met: set[int] = set()
                for word in set(re.findall(r"[^\W_]+", text.lower())):
                    terms = near.get(word)
                    if terms is None:
                        found = automaton.matches(word)
                        terms = () if found and min(found)[0] == 0 else tuple(k for _, k in found)
                        if len(word) <= _KEPT_LETTERS:
                            if len(near) > _KEPT_WORDS:
                                near.clear()
                            near[word] = terms
                        if len(automaton.steps) > _KEPT_STEPS:
                            automaton.forget()
                    met.update(terms)
                seen[int(label > 0), list(met)] += 1
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.record_batch({"term": pa.array(at, pa.int32()), "clean": pa.array(seen[0, at]), "toxic": pa.array(seen[1, at])})

    counts = sample.select("label", "text").mapInArrow(work, "term int, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    bad = {r.term for r in counts.collect() if r.toxic < LEAST_PRECISION * (r.toxic + r.clean)}  # a row for each term at most
    return [0 if k in bad else n for k, n in enumerate(first)]


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> ToxicityModel:
    """Learns the lexicon (a Spark aggregation over the sample's words) and fits the weights."""
    sample = training_sample(docs, labels, "toxic", rows).persist()
    try:
        toxic, total = sample.agg(F.coalesce(F.sum(F.col("label")), F.lit(0)), F.count("*")).first()
        if not toxic or toxic == total:
            return ToxicityModel((), (), (0.0,) * len(FEATURES), float(np.log((toxic + 0.5) / (total - toxic + 0.5))))
        words = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
        pairs = F.zip_with(words, F.concat(F.array(F.lit("")), words), lambda w, before: F.struct(w.alias("word"), before.alias("before")))
        counted = (
            sample.select("doc_id", "label", F.explode(pairs).alias("x"))
            .where(F.length("x.word").between(3, 30))
            .groupBy("doc_id", "label", F.col("x.word").alias("word"))
            .agg(F.min("x.before").alias("before"))
            .groupBy("word")
            .agg(F.sum("label").alias("toxic"), F.count("*").alias("rows"), F.approx_count_distinct("before").alias("contexts"))
        )
        share, base = F.col("toxic") / F.col("rows"), toxic / total
        clean = 1 - share
        evidence = F.col("rows") * (share * F.log(share / base) + F.when(clean > 0, clean * F.log(clean / (1 - base))).otherwise(0.0))
        terms = counted.where("toxic > 0").where((share >= max(LEAST_PRECISION, base)) & (evidence >= LEAST_EVIDENCE) & (F.col("contexts") >= LEAST_CONTEXTS * F.col("rows")))
        lexicon = sorted(r.word for r in terms.orderBy(F.desc(evidence), "word").limit(TERMS).collect())
        limits = tolerances(sample, lexicon)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(lexicon, limits)
            for batch in slices(batches):
                found = [scanner.features(x) for x in batch["text"].to_pylist()]
                yield pa.record_batch({"label": batch["label"], "features": pa.array(found, pa.list_(pa.float64()))})

        seen = sample.select("label", "text").mapInArrow(work, "label int, features array<double>").collect()  # at most ``rows`` rows of a few numbers
    finally:
        sample.unpersist()
    weights, bias = logistic(np.array([r.features for r in seen]), np.array([r.label for r in seen], float))
    return ToxicityModel(tuple(lexicon), tuple(limits), tuple(weights.tolist()), bias)


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", output: str = "toxicity") -> DataFrame:
    """``docs`` with ``output``: the score of each text. One pass, no shuffle; all other columns pass through."""
    docs = docs.drop(output)
    schema = StructType([*docs.schema.fields, StructField(output, DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, weights = Scanner(list(model.terms), list(model.limits)), np.array(model.weights)
        for batch in slices(batches):
            x = np.array([scanner.features(t or "") for t in batch[text_col].to_pylist()]).reshape(-1, len(FEATURES))
            score = pa.array(1 / (1 + np.exp(-np.clip(x @ weights + model.bias, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, output])

    return docs.mapInArrow(work, schema)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    return with_toxicity(id_and_text(docs, id_col, text_col), model, output="score").select("doc_id", "score")


def scored_with_folds(scores: DataFrame, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scores.select("doc_id", F.coalesce(~in_training_folds(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
