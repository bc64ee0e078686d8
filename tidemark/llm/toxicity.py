"""Toxicity: a Levenshtein automaton over a lexicon trie, and context windows.

* The lexicon is learned from labelled rows: words that are far likelier in toxic texts than in
  clean ones, counted over groups of near copies (not rows), so a much copied text counts once.
  Toxic use is counted in the sample, and clean use in all clean texts, brought to the sample's share
  of toxic texts: the test against chance has the class balance of the corpus at every size.
  Clean use is gathered in one pass: of each text only its group and the few words in question leave the task.
* Learning and scoring take the same words: runs of letters, digits, @ and $, wherever they touch.
* The trie of the lexicon is intersected with the Levenshtein automaton of at most ``distance``
  edits (one, from eight letters on two).  The product is made deterministic as it is used: a state is the set of
  (trie node, edits so far), and its transitions are kept, so a token costs one lookup a letter
  and most tokens die after two or three letters.  Terms shorter than ``min_fuzzy`` match exactly.  Letters
  repeated three times and more are tried as one.
* Every match is judged in a window of ``WINDOW`` tokens on both sides: between quote marks, or
  behind a reporting verb, it counts as quotation, else as abuse.  The two have features of
  their own, and a logistic model weighs them; with no evidence for it, quotation adds nothing.

Other fitting is on a bounded sample: at most about ``PER_CLASS`` labelled texts of each class,
by id hash.  The model (a lexicon out of the sample's words and a few weights) is broadcast.
Scoring is one map pass over whole texts.

Edge cases: null and empty texts score as a text without matches; without labelled rows of both
classes every score is 0; repeated labels of one id count as toxic if any says so; null ids and
null labels are not fitted on; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, save, small_batches

PER_CLASS = 10_000
MIN_GROUPS = 5
#: Standard deviations by which a term's toxic count exceeds chance, so that small samples teach no noise.
MIN_DEVIATION = 6.0
#: Quoted passages of a line, which are left out when the lexicon is learned.
QUOTED = re.compile("[\"“„«][^\"“”„«»\n]+[\"”“»]")
WORD = re.compile(r"[\w@$]+")
STRETCHED = re.compile(r"(.)\1{2,}")
MIN_LOG_ODDS = math.log(8.0)
#: Edits of terms from LONG letters on, of which shorter ones get one and those below MIN_FUZZY none.
DISTANCE, MIN_FUZZY, LONG = 2, 5, 8
WINDOW = 6
THRESHOLD = 0.3
CACHE_TOKENS = 300_000

STRIP = ".,;:!?\"'`()[]{}<>«»„“”‚‘’…*_~#&%$^|/\\+=-"
OPENING, CLOSING = tuple("\"“„«‚‘»"), tuple("\"”“»’«")
#: Verbs that report speech.
REPORTING = frozenset("said says say wrote writes called calls quoted quotes quoting replied "
                      "shouted yelled term word phrase".split())
FEATURES = 6


# ---------------------------------------------------------------- automaton

class LexiconAutomaton:
    """Deterministic product of a lexicon trie and a Levenshtein automaton, made as it is used."""

    def __init__(self, terms: list[str], distance: int = DISTANCE, min_fuzzy: int = MIN_FUZZY, long: int = 0):
        self.terms = terms
        self.allowed = [0 if len(t) < min_fuzzy else distance if len(t) >= long else min(1, distance) for t in terms]
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[int] = [-1]
        self.reach = [0]  # most edits that a term below the node allows
        for k, term in enumerate(terms):
            node = 0
            self.reach[0] = max(self.reach[0], self.allowed[k])
            for ch in term:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term_at.append(-1)
                    self.reach.append(0)
                node = self.children[node][ch]
                self.reach[node] = max(self.reach[node], self.allowed[k])
            self.term_at[node] = k
        self.states: dict[frozenset, int] = {}
        self.members: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """Number of the state for {trie node: fewest edits}, closed under skipped lexicon letters."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                if nodes[node] < self.reach[child] and nodes.get(child, nodes[node] + 2) > nodes[node] + 1:
                    nodes[child] = nodes[node] + 1
                    todo.append(child)
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(nodes)
            self.moves.append({})
            found = [(e, self.term_at[n]) for n, e in nodes.items() if self.term_at[n] >= 0 and e <= self.allowed[self.term_at[n]]]
            best = min(found, default=None)
            self.accepts.append(None if best is None else (best[1], best[0]))
        return self.states[key]

    def _step(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}

        def add(node: int, edits: int) -> None:
            if edits <= self.reach[node] and out.get(node, edits + 1) > edits:
                out[node] = edits

        for node, edits in self.members[state].items():
            add(node, edits + 1)                              # a letter too many
            for c, child in self.children[node].items():
                add(child, edits + (c != ch))                 # the letter, or another in its place
        to = self.moves[state][ch] = self._state(out)
        return to

    def match(self, token: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term within the distance, else None."""
        state = self.start
        for ch in token:
            moves = self.moves[state]
            state = moves[ch] if ch in moves else self._step(state, ch)
            if state == self.dead:
                return None
        return self.accepts[state]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower().replace("_", " "))


class TokenMatches(dict):
    """Blank-separated token -> matches of its words, filled on demand and emptied when it has grown too large."""

    def __init__(self, automaton: LexiconAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, token: str):
        if len(self) >= CACHE_TOKENS:
            self.clear()
        found = [self.automaton.match(w) or self.automaton.match(STRETCHED.sub(r"\1", w)) for w in words_of(token)]
        out = self[token] = tuple(m for m in found if m)
        return out


def is_quoted(tokens: list[str], k: int) -> bool:
    """Whether token k stands between quote marks, or behind a reporting verb, in its window."""
    lo, hi = max(0, k - WINDOW), min(len(tokens), k + WINDOW + 1)
    opened = any(t.startswith(OPENING) for t in tokens[lo:k + 1])
    if opened and any(t.rstrip(".,;:!?").endswith(CLOSING) for t in tokens[k:hi]):
        return True
    return any(t.strip(STRIP).lower() in REPORTING for t in tokens[max(0, k - 3):k])


def text_matches(text: str, cache: TokenMatches) -> list[tuple[int, int, bool]]:
    """(term, edits, quoted) of every match in a text."""
    tokens = text.split()
    found = list(map(cache.__getitem__, tokens))
    return [(t, e, quoted) for k, hits in enumerate(found) if hits for quoted in [is_quoted(tokens, k)] for t, e in hits]


# ---------------------------------------------------------------- model

def features(matches: list[tuple[int, int, bool]], weights: dict[tuple[int, int], float]) -> np.ndarray:
    """For abuse and for quotation: the largest weight, the sum of weights (damped), and matches at all."""
    x = np.zeros(FEATURES)
    for quoted in (False, True):
        w = [weights.get((t, e), 0.0) for t, e, q in matches if q == quoted]
        if w:
            x[3 * quoted:3 * quoted + 3] = max(w), math.log1p(max(0.0, sum(w))), 1.0
    return x


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic model; the last coefficient is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def score_matches(matches: list[tuple[int, int, bool]], model: dict) -> float:
    if model["beta"] is None:
        return 0.0
    z = float(features(matches, model["weights"]) @ model["beta"][:-1] + model["beta"][-1])
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, float], DataFrame]:
    """(doc_id, text, toxic) of at most about ``per_class`` texts of each class, the row weight
    of each class that makes up for the sampling, and (doc_id, toxic) of all of ``docs`` with a label."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = save(marked.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled_ids")
    counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    keep, weights = F.lit(False), {}
    for y, n in sorted(counts.items()):
        share = min(1.0, per_class / n)
        weights[y] = 1.0 / share
        keep = keep | ((F.col("toxic") == y)
                       & (F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) < int(share * (1 << 30))))
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # The sample has about 2 * per_class rows (id, class) at any size, so it is broadcast and no text moves.
    return texts.join(F.broadcast(marked.filter(keep)), "doc_id"), weights, marked


def group_of(words: set[str]) -> int:
    """A number that near copies mostly share: from the six smallest word hashes of a text."""
    small = nsmallest(6, {zlib.crc32(w.encode("utf-8", "replace")) for w in words})
    return zlib.crc32(repr(small).encode()) << 31 | len(small) << 28 | (small[0] if small else 0) >> 4


def word_facts(rows: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(key, g, words) of each row of (key, text): its group, and its distinct words outside quotation marks (of the bounded
    list ``wanted`` only, where given)."""
    keep = None if wanted is None else rows.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, words = [], []
            for text in as_text(batch.column(1)):
                found = set(words_of(QUOTED.sub(" ", text)))
                groups.append(group_of(found))
                words.append([w for w in found if len(w) >= 3] if keep is None else list(found & keep.value))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(groups, pa.int64()), pa.array(words, pa.list_(pa.string()))],
                                             names=["key", "g", "words"])

    return rows.mapInArrow(run, "key long, g long, words array<string>")


def learn_lexicon(sample: DataFrame, weights: dict[int, float], docs: DataFrame, marked: DataFrame) -> list[str]:
    """Words far likelier in toxic texts outside quotation marks, counted over groups of near copies."""
    rows = save(word_facts(sample.select("toxic", "text")), "sample_words")
    totals = {r.key: r.n for r in rows.groupBy("key").agg(F.countDistinct("g").alias("n")).collect()}
    if len(totals) < 2:
        return []
    per_word = (rows.select("key", "g", F.explode("words").alias("word")).distinct().groupBy("word")
                .agg(F.sum("key").alias("t"), F.sum(1 - F.col("key")).alias("c")).filter(F.col("t") >= MIN_GROUPS))
    # The mean clean use of a term is at most ``most`` groups of the sample; three deviations and one more are out of question,
    # and so is a word that is not even twice as frequent in the toxic part.
    most = (F.col("t") + 0.5) / (totals[1] + 1.0) * (totals[0] + 1.0) / math.exp(MIN_LOG_ODDS)
    per_word = save(per_word.filter(F.col("c") <= F.least(most + 3 * F.sqrt(most) + 1, (F.col("t") + 0.5) * totals[0] / totals[1] / 2)).select("word", "t"), "toxic_words")
    in_question = [r.word for r in per_word.select("word").collect()]  # words of the bounded sample
    facts = save(word_facts(docs.select("doc_id", "text"), in_question), "word_facts")
    clean_rows = save(facts.join(marked.filter("toxic = 0").select(F.col("doc_id").alias("key")), "key", "left_semi")
                      .select("g", "words"), "clean_words")
    clean = clean_rows.agg(F.countDistinct("g")).first()[0] / weights[1]
    used = clean_rows.select("g", F.explode("words").alias("word")).distinct().groupBy("word").agg(F.count("*").alias("used"))
    per_word = per_word.join(used, "word", "left").withColumn("c", F.coalesce("used", F.lit(0)) / weights[1])
    n, base = F.col("t") + F.col("c"), totals[1] / (totals[1] + clean)
    above = (F.col("t") - n * base) / F.sqrt(n * base * (1 - base))
    odds = F.log((F.col("t") + 0.5) / (totals[1] + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    return sorted(r.word for r in per_word.filter((above >= MIN_DEVIATION) & (odds >= MIN_LOG_ODDS)).select("word").collect())


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict:
    """Model from documents and labels (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    sample, class_weight, marked = training_sample(docs, labels, per_class)
    sample = save(sample, "toxic_sample")
    terms = learn_lexicon(sample, class_weight, docs, marked)
    empty = {"terms": terms, "weights": {}, "beta": None}
    if not terms:
        return empty
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = TokenMatches(LexiconAutomaton(shared.value, DISTANCE, MIN_FUZZY, LONG))
        for batch in batches:
            hits = [text_matches(t, cache) for t in as_text(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int32()),
                 pa.array([[t for t, _, _ in h] for h in hits], pa.list_(pa.int32())),
                 pa.array([[e for _, e, _ in h] for h in hits], pa.list_(pa.int32())),
                 pa.array([[q for _, _, q in h] for h in hits], pa.list_(pa.bool_()))],
                names=["toxic", "term", "edits", "quoted"])

    # Matches of the bounded sample only.
    rows = sample.select("text", "toxic").mapInArrow(
        run, "toxic int, term array<int>, edits array<int>, quoted array<boolean>").collect()
    matches = [list(zip(r.term, r.edits, r.quoted)) for r in rows]
    y = np.array([r.toxic for r in rows], dtype=float)
    row_weight = np.array([class_weight[r.toxic] for r in rows])
    n1, n0 = row_weight[y == 1].sum(), row_weight[y == 0].sum()
    seen: dict[tuple[int, int], list[float]] = {}
    for m, label, w in zip(matches, y, row_weight):
        for key in {(t, e) for t, e, quoted in m if not quoted}:
            seen.setdefault(key, [0.0, 0.0])[int(label)] += w
    weights = {k: math.log((t + 0.5) / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1)) for k, (c, t) in seen.items()}
    for t in range(len(terms)):
        # Edits that the sample never shows count for half of the term itself each.
        weights.setdefault((t, 0), MIN_LOG_ODDS)
        for e in range(1, DISTANCE + 1):
            weights.setdefault((t, e), 0.5 ** e * weights[t, 0])
    x = np.stack([features(m, weights) for m in matches])
    return {"terms": terms, "weights": weights, "beta": fit_logistic(x, y, row_weight)}


def scorer(spark, model: dict, text: str = "text") -> Column:
    """Score column (0 to 1) for a text column; the bounded model is broadcast."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = TokenMatches(LexiconAutomaton(shared.value["terms"], DISTANCE, MIN_FUZZY, LONG))
        for col in batches:
            yield pa.array([score_matches(text_matches(t, cache), shared.value) for t in as_text(col)], pa.float64())

    return run(F.col(text))


def score_documents(docs: DataFrame, train_docs: DataFrame, labels: DataFrame,
                    per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``, by a model fitted on ``train_docs``."""
    model = fit(train_docs, labels, per_class)
    return docs.select("doc_id", scorer(docs.sparkSession, model).alias("score")) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
